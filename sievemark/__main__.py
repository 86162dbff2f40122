"""Command line: judge raw messages of a file or folder and write reports.

    python -m sievemark MESSAGES --out FOLDER [--formats json,txt,html,stix,docx,pdf] [--feed FILE] [--trusted ID]

MESSAGES and FOLDER may be anywhere that Spark reads (FOLDER: that Arrow opens); reports appear together once all are written, or not at all.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators.reports import docx_column, html_column, json_column, lines_column, pdf_column, stix_column
from .plans.triage import analyze
from .sources.connectors import ReportSink
from .sources.mail import read_folder

FORMATS = ("json", "txt", "html", "stix", "docx", "pdf")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sievemark", description=__doc__.splitlines()[0])
    parser.add_argument("messages")
    parser.add_argument("--out", required=True)
    parser.add_argument("--pattern", default="*.eml")
    parser.add_argument("--formats", default="json", type=lambda x: [f for f in x.split(",") if f])
    parser.add_argument("--feed", help="indicators: one a line with # comments, or a JSON list")
    parser.add_argument("--trusted", action="append", default=[], help="an authserv-id whose results count")
    given = parser.parse_args(arguments)
    if unknown := sorted({*given.formats} - {*FORMATS}):
        parser.error(f"unknown formats: {', '.join(unknown)}")
    spark = SparkSession.builder.getOrCreate()
    feed = None
    if given.feed:
        from .operators.feeds import read_feed

        feed = read_feed(spark, given.feed, "local")
    results = analyze(read_folder(spark, given.messages, given.pattern), trusted=tuple(given.trusted), feed=feed)
    made = {
        "json": json_column(results).cast("binary"), "txt": F.array_join(lines_column(), "\n").cast("binary"), "html": html_column().cast("binary"), "stix": stix_column(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("binary"),
        "docx": docx_column(lines_column()), "pdf": pdf_column(lines_column()),
    }
    name = F.coalesce("case_id", "message_id")
    each = F.array(*(F.struct(F.concat(name, F.lit(f".{f}")).alias("name"), F.when(F.col("error").isNull(), made[f]).alias("content")) for f in given.formats))
    rows = results.select(F.inline(each)).where("content IS NOT NULL")
    spark.dataSource.register(ReportSink)
    counted = Observation()
    rows.observe(counted, F.count("*").alias("n")).write.format("reports").mode("append").save(given.out)
    total, folder = counted.get["n"], given.out
    print(f"{total or 0} reports in {folder}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

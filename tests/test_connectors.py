"""Mail folders and mailboxes as tables and streams; reports that appear together or not at all."""

import io
import os

import pytest
from pyspark.sql import functions as F

from sievemark.sources import connectors
from sievemark.sources.connectors import MailSource, ReportSink, planned, split_mailbox
from sievemark.sources.mail import MAX_BYTES

BODIES = [b"Subject: a\n\nso\nFrom here on\nit goes\n", b"Subject: b\n\n\n>From quoted\n", b"", b"Subject: c\r\n\r\nx\r\n", b"y" * 5000 + b"\n", b"last, no newline"]
MAILBOX = b"".join(b"From me@x Mon\n" + b + b"\n" for b in BODIES[:-1]) + b"From z\n" + BODIES[-1]
WANT = [b.replace(b">From", b"From") for b in BODIES]


def test_mailbox_splits():
    places = [p for p, _ in split_mailbox(io.BytesIO(MAILBOX), 0, len(MAILBOX))]
    assert [b.rstrip(b"\n") for _, b in split_mailbox(io.BytesIO(MAILBOX), 0, len(MAILBOX))] == [w.rstrip(b"\n") for w in WANT]
    for size in (1, 2, 3, 7, 64, 1000, 5050):
        got = [x for at in range(0, len(MAILBOX), size) for x in split_mailbox(io.BytesIO(MAILBOX), at, min(at + size, len(MAILBOX)))]
        assert [p for p, _ in got] == places and [b.rstrip(b"\n") for _, b in got] == [w.rstrip(b"\n") for w in WANT], size
    large = b"From a\n" + b"x" * (MAX_BYTES + 50_000) + b"\n\nFrom b\nsmall\n"
    assert [len(b) for _, b in split_mailbox(io.BytesIO(large), 0, len(large))] == [MAX_BYTES + 1, 6]
    assert list(split_mailbox(io.BytesIO(b""), 0, 0)) == [] and list(split_mailbox(io.BytesIO(b"no start\n\nhere"), 0, 14)) == []


def test_parts(monkeypatch):
    monkeypatch.setattr(connectors, "SPLIT", 100)
    parts = planned([(1, "a.mbox", 250), (2, "b.eml", 60), (3, "c.eml", 60), (4, "d.eml", 5)])
    assert [(p.mailbox, p.start, p.end, p.files) for p in parts] == [("a.mbox", 0, 100, []), ("a.mbox", 100, 200, []), ("a.mbox", 200, 250, []), (None, 0, 0, ["b.eml", "c.eml"]), (None, 0, 0, ["d.eml"])]


def test_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(MailSource)
    inbox = tmp_path / "in"
    inbox.mkdir()
    assert spark.read.format("mail").load(str(inbox)).count() == 0
    (inbox / "a.eml").write_bytes(b"Subject: one\n\nhi")
    (inbox / "b.mbox").write_bytes(MAILBOX)
    (inbox / "_skip.eml").write_bytes(b"x")
    rows = spark.read.format("mail").load(str(inbox)).collect()
    assert len(rows) == 1 + len(BODIES) and spark.read.format("mail").option("pattern", "*.eml").load(str(inbox)).count() == 1
    seen = spark.readStream.format("mail").load(str(inbox))

    def drained():
        query = seen.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert drained() == 1 + len(BODIES)
    (inbox / "c.eml").write_bytes(b"Subject: later\n\nhi")
    os.utime(inbox / "c.eml", ns=(4 * 10**18, 4 * 10**18))
    assert drained() == 2 + len(BODIES)


def test_reports_all_or_none(spark, tmp_path):
    spark.dataSource.register(ReportSink)
    out = tmp_path / "reports"
    rows = spark.range(0, 20, 1, 4).select(F.concat(F.lit("r"), F.col("id") % 15, F.lit(".txt")).alias("name"), F.concat(F.lit("text "), F.col("id") % 15).cast("binary").alias("content"))
    rows.write.format("reports").mode("append").save(str(out))
    assert {p.name: p.read_text() for p in out.iterdir()} == {f"r{i}.txt": f"text {i}" for i in range(15)}
    failing = rows.select("name", F.when(F.col("name") == "r13.txt", F.raise_error(F.lit("no"))).otherwise(F.lit(b"new")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="no"):
        failing.write.format("reports").mode("append").save(str(out))
    with pytest.raises(Exception, match="not a report's name"):
        spark.createDataFrame([("../x", b"x")], "name string, content binary").write.format("reports").mode("append").save(str(out))
    assert {p.name: p.read_text() for p in out.iterdir()} == {f"r{i}.txt": f"text {i}" for i in range(15)}
    rows.limit(1).write.format("reports").mode("overwrite").save(str(out))
    assert len(list(out.iterdir())) == 1

"""A corpus pipeline: toxic documents go, one of each group of near duplicates
stays, repeated passages are cut to their first copy, personal data is masked,
and what remains is packed into training sequences.

Each stage takes the rows that its predecessor kept and all but the last return
the columns of ``documents``. Null texts stay null through the filters and count
as empty afterwards; rows with null ids are never called duplicates; repeated
rows with ids leave the second stage once; empty tables pass through; further columns
are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import near_dedup, packing, pii, suffix_dedup, toxicity
from sievemark.llm.common import materialize, table, text_or_empty


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), use=~toxicity.held_out())
    scored = toxicity.score(docs, model, keep=docs.columns)
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row is known by id and text, as an id may stand on several; rows with null ids have no key
    named = docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64(text_or_empty()).alias("th"))))
    copies = near_dedup.find(named, key="__key").where(~F.col("kept")).select("__key").distinct()
    left = named.join(materialize(copies, "pipeline-copies"), "__key", "left_anti")
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return left.withColumn("__own", own).dropDuplicates(["doc_id", "text", "__own"]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = suffix_dedup.removed(docs, keep="first", carry=carried, whole_chars=True)
    return out.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: No stage but the fourth can be put in SQL; tests/llm holds the whole against plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs

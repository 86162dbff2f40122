"""Token counts of whole texts by batch encoding in Arrow functions that return lengths only.

Batches of texts are balanced by bytes, not by rows, and a long text ends its
batch. Long texts are cut at borders that the tokenizer never crosses (see
``wordcodes``), so memory stays bounded and the count equals that of the whole
text. A null text counts as empty. Repeated rows and rows with null keys each keep their own count, an
empty table gives an empty result, and further columns of the input, whatever
their names, stay out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .wordcodes import forget, groups, library

#: UTF-8 bytes of a batch of texts, or a little more.
GROUP_BYTES = 1 << 19


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of docs: key, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library(tokenizer, "lengths")
        for batch in batches:
            totals: list[int] = []
            for group in groups(batch.column(2).to_pylist(), GROUP_BYTES, batch.column(1).to_pylist()):
                if len(group) == 1:  # a long text comes in parts, each counted before the next is split
                    totals.append(sum(map(sum, words.of(group[0]))))
                else:
                    totals += map(sum, words.codes(group))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64())], names=["k", "n_bytes", "n_tokens"])
        forget()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(counted, f"k {kind}, n_bytes long, n_tokens long").select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

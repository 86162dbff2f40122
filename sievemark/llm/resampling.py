"""Importance resampling towards a target's distribution of word n-grams.

Texts become rows of a sparse document-by-bucket count matrix, which is written
once as blocks in compressed sparse rows (CSR): document keys, row pointers,
bucket numbers and counts, each block some thousand documents or so many
entries. From then on texts aren't read again:

* Column sums of the blocks give the corpus's distribution over the buckets;
  those of the target's matrix its own. A task adds up its blocks and sends one
  row for each bucket, so a shuffle never holds more than ``BUCKETS`` rows a task.
* A bucket's gain is the logarithm of the ratio of both distributions, smoothed
  by one; there are ``BUCKETS`` gains, however large the corpus is.
* The product of the sparse matrix with the gains gives each document's sum,
  exactly, as gains are whole numbers; its floored mean is the weight.
* Weight plus Gumbel noise, drawn from a hash of the key, is the score, and the
  documents with the highest scores are a sample without replacement. Ranks
  come from a sort by ranges and the sizes of the ranges before, so no task
  ranks all documents.

Defined cases: null and empty texts have no features and weight 0. A null key
is hashed as if it were empty and comes after others of its score; rows alike
in score and key (repeated rows, say) take ranks one after the other. Empty
tables give an empty result, an empty target counts as one without features.
Texts of any length are taken whole: a row of the matrix has at most
``BUCKETS`` entries. Columns other than key and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, shuffle_partitions, table, text_or_empty

BUCKETS, ORDER = 10_000, 2
#: Documents with fewer words aren't drawn; so many in a hundred of the others are.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Entries and documents of a block, about.
BLOCK_ENTRIES, BLOCK_ROWS = 1 << 18, 1 << 12
#: Bytes of a text whose words are counted at a time.
PART_BYTES = 1 << 21
#: Documents in a range of the sort by score, on average.
RANGE_ROWS = 1 << 16
#: Words that a worker remembers, and those kept when it starts anew: what was met first is met often.
REMEMBERED, KEPT = 400_000, 50_000
#: Bytes of a second word up to which checksums are joined by tables.
JOINED = 48

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MATRIX = "{key} n_words array<long>, n_features array<long>, indptr binary, buckets binary, counts binary"


def _shifts() -> np.ndarray:
    """By a number of zero bytes that follow, and by place and value of a checksum's byte: what the checksum becomes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (step >> np.uint32(1))
    tables = [np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]]
    for _ in range(JOINED):
        tables.append((tables[-1] >> np.uint32(8)) ^ step[tables[-1] & np.uint32(255)])
    return np.array(tables)


class Checksums:
    """CRC-32 of words, and of two words with a space between them from the checksums of both: crc(ab) is crc(a), shifted by b's length, xor crc(b)."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.shifts = _shifts()
        self.rows = np.zeros((3, 1 << 12), dtype=np.uint32)  # of the word, of the word and a space, bytes

    def add(self, words: list[bytes]) -> None:
        first, last = len(self.known), len(self.known) + len(words)
        if last > self.rows.shape[1]:
            self.rows = np.hstack([self.rows, np.zeros((3, last), dtype=np.uint32)])
        self.known.update(zip(words, range(first, last), strict=True))
        own = [zlib.crc32(word) for word in words]
        self.rows[:, first:last] = own, [zlib.crc32(b" ", crc) for crc in own], [len(word) for word in words]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Checksums of the words and of the pairs of neighbours."""
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), KEPT))
        new = set(words).difference(self.known)
        if new:
            self.add(list(new))
        own, spaced, size = self.rows[:, np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]
        left, n = spaced[:-1], np.minimum(size[1:], JOINED)
        pairs = own[1:].copy()
        for k in range(4):
            pairs ^= self.shifts[n, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(size[1:] > JOINED).tolist():
            pairs[i] = zlib.crc32(words[i + 1], int(left[i]))
        return own, pairs


_checksums: Checksums | None = None


def _parts(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, part by part."""
    at = 0
    while at < len(data):
        end = at + PART_BYTES
        if end < len(data):  # a part ends behind a word
            found = WORD.match(data, end)
            end = found.end() if found else end
        yield WORD.findall(data, at, end)
        at = end


def counted(text: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, and the buckets that occur with their counts."""
    global _checksums
    _checksums = _checksums or Checksums()
    words = features = 0
    total = np.zeros(BUCKETS, dtype=np.int64)
    last: list[bytes] = []
    for found in _parts(text.encode("utf-8", "surrogatepass").lower()):
        if found:
            own, pairs = _checksums.of(last + found)
            own = own[len(last) :]
            total += np.bincount(np.concatenate([own, pairs]) % np.uint32(BUCKETS), minlength=BUCKETS)
            words, features, last = words + len(own), features + len(own) + len(pairs), found[-1:]
    at = np.flatnonzero(total)
    return words, features, at, total[at]


def forget() -> None:
    """Gives back what the worker remembers, for the stages that run in it afterwards."""
    global _checksums
    _checksums = None
    release()


def matrix(docs: DataFrame, key: str | None = "doc_id", text: str = "text") -> DataFrame:
    """The count matrix of docs as CSR blocks, written as a table: k (the rows' keys, if any), n_words, n_features, indptr, buckets, counts."""
    kind = docs.schema[key].dataType.simpleString() if key else None

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, held = [], [], 0

        def block() -> pa.RecordBatch:
            pointers = np.cumsum([0, *(len(r[2]) for r in rows)])
            columns = [pa.array([[r[i] for r in rows]], pa.list_(pa.int64())) for i in (0, 1)]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in (pointers.astype("<i8"), np.concatenate([r[2] for r in rows]).astype("<u2"), np.concatenate([r[3] for r in rows]).astype("<u4"))]
            names = ["n_words", "n_features", "indptr", "buckets", "counts"]
            if key:
                columns.insert(0, pa.array([keys], pa.list_(key_type)))
                names.insert(0, "k")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            key_type = batch.schema.field(1).type if key else None
            for i, value in enumerate(batch.column(0)):
                own = counted(value.as_py())
                rows.append((*own[:2], own[2].astype(np.uint16), own[3].astype(np.uint32)))
                held += len(own[2])
                if key:
                    keys.append(batch.column(1)[i].as_py())
                if held >= BLOCK_ENTRIES or len(rows) >= BLOCK_ROWS:
                    yield block()
                    keys, rows, held = [], [], 0
        if rows:
            yield block()
        forget()

    picked = [text_or_empty(text).alias("t"), *([F.col(key).alias("k")] if key else [])]
    return materialize(docs.select(*picked).mapInArrow(blocks, MATRIX.format(key=f"k array<{kind}>," if key else "")), "resampling-matrix")


def _numbers(column: pa.Array, i: int, kind: str) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), dtype=kind)


def column_sums(blocks: DataFrame) -> np.ndarray:
    """How often each bucket occurs: BUCKETS whole numbers."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += np.bincount(_numbers(batch.column(0), i, "<u2"), _numbers(batch.column(1), i, "<u4"), BUCKETS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    got = blocks.select("buckets", "counts").mapInArrow(parts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's share in the target over that in the source, rounded down."""
    every, wanted = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = [((t + 1) * every) / ((s + 1) * wanted) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weighted(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """k, n_words, n_features, weight of every row of the matrix."""
    kind = blocks.schema["k"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, features = (batch.column(c)[i].values.to_numpy() for c in (1, 2))
                pointers = _numbers(batch.column(3), i, "<i8")
                each = np.concatenate([[0], np.cumsum(gain[_numbers(batch.column(4), i, "<u2")] * _numbers(batch.column(5), i, "<u4").astype(np.int64))])
                total = each[pointers[1:]] - each[pointers[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(words), pa.array(features), pa.array(total // np.maximum(features, 1))], names=["k", "n_words", "n_features", "weight"])

    return blocks.select("k", "n_words", "n_features", "indptr", "buckets", "counts").mapInArrow(rows, f"k {kind}, n_words long, n_features long, weight long")


def noise(key: str, seed: int = SEED):
    """A thousand times Gumbel noise from a hash of the key, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *by) -> DataFrame:
    """rows with their rank in the order by, from 1: ranges are sorted side by side, and a range starts behind the sizes of those before."""
    spark = rows.sparkSession
    total = rows.count()
    ranges = max(1, min(math.ceil(total / RANGE_ROWS), 1 << 16), min(shuffle_partitions(spark), total))
    fields = rows.schema.fieldNames()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, own, dtype=np.int32)), pa.array(np.arange(at, at + n))], names=[*fields, "__range", "__at"])
            at += n

    ordered = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = materialize(ordered.mapInArrow(placed, f"{kinds}, __range int, __at long"), "ranges")
    sizes = {r["__range"]: r["n"] for r in out.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    before, first = 0, []
    for i in range(max(sizes, default=-1) + 1):
        first.append(before)
        before += sizes.get(i, 0)
    starts = spark.createDataFrame([(i, n) for i, n in enumerate(first)], "__range int, __first long")
    return out.join(F.broadcast(starts), "__range").select(*fields, (F.col("__first") + F.col("__at") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """key, n_features, weight, score, rank (null where not drawn) of every row of docs."""
    blocks = matrix(docs, key, text)
    gain = gains(column_sums(blocks), column_sums(matrix(target, None, text)))
    rows = materialize(weighted(blocks, gain).withColumn("score", F.col("weight") + noise("k", seed)), "resampling-scores")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = (F.desc("score"), F.col("k").asc_nulls_last())
    out = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    best = ranked(able.select("k", "n_features", "weight", "score"), *order).select("k", "n_features", "weight", "score", out)
    rest = rows.where(F.col("n_words") < least_words).select("k", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return best.unionByName(rest).withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PAIRS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
_BYTE = "16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1"
ORACLE_SQL = f"""
WITH RECURSIVE steps AS (SELECT i AS n, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
fd AS (SELECT r, unnest(list_concat(w, {_PAIRS})) AS f FROM d),
fb AS (SELECT unnest(list_concat(w, {_PAIRS})) AS f FROM b),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
own AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: CAST({_BYTE} AS BIGINT))), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) % {BUCKETS} AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN own USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fb JOIN own USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM fd) + {BUCKETS}) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM fb) + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM fd JOIN own USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, r, len(d.w) AS words, coalesce(n, 0) AS n_features, coalesce(total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END, 0) AS weight,
  CAST(concat('0x', substr(sha256(concat('{SEED}:', doc_id)), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, CASE WHEN words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM y WHERE words >= {LEAST_WORDS}) // 100 THEN CAST(place AS BIGINT) END AS rank FROM z
"""

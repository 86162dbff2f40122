"""Near-duplicate documents: MinHash bands propose, sequential Bayesian comparison prunes, full sets confirm.

Texts with the same set of word shingles form a class; classes, not documents,
are compared. Band keys of the signatures gather classes in buckets, whose links
``linking.connect`` finds by contracting rounds and a closing one.

Signatures are compared in batches of hashes: with a uniform prior the
posterior probability that the similarity reaches the threshold after m of n
equal hashes is a binomial tail, and the pair is dropped once that falls below
``MISS``. What survives is counted on the full sets. A link at the threshold
goes unseen with a probability below 7e-6: 8e-7 for sharing no band, and 6e-6
for being dropped at any of the looks at its signature.

Null texts and texts without words have empty sets and link with nothing;
repeated rows and equal keys are kept, each with its result. Rows with null keys
link like all others but give no component its id: it is null where a component
has no other keys, and ``kept`` is true for them. An empty table gives an empty
result, and further columns of the input are ignored. Texts of any length are
taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table, text_or_empty
from .linking import class_of, connect, met, resolved, sets_of

WORDS, THRESHOLD = 5, 75
BANDS, ROWS, STEP, MISS = 72, 6, 27, 5e-7
#: Bands that a class shares with its pivot at least; the closing round has no such bound.
LEAST_BANDS = 2
#: Words whose hashes a worker remembers, and those kept when it starts anew: what was met first is met often.
REMEMBERED, KEPT = 250_000, 50_000

_SEED = np.random.default_rng(20_231)
_A = _SEED.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _SEED.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the text's shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(_known) > REMEMBERED:
        often = list(islice(_known.items(), KEPT))
        _known.clear()
        _known.update(often)
    for word in set(found).difference(_known):
        _known[word] = xxhash.xxh3_64_intdigest(word)
    codes = np.fromiter(map(_known.__getitem__, found), dtype=np.uint64, count=len(found))
    span = min(words, len(codes))
    total = np.full(len(codes) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        total = (total ^ codes[i : len(codes) - span + 1 + i]) * _FACTOR
        total ^= total >> np.uint64(29)
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(out, ((low[at : at + 1024, None] ^ _B) * _A).min(axis=0), out=out)
    return out


def forget() -> None:
    """Gives back what the worker remembers, for the stages that run in it afterwards."""
    _known.clear()
    release()


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest equal hashes of n with which the posterior probability of similarity >= threshold reaches miss."""
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n + 1


def signed(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, n (set size), cls (null for empty sets), sig."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, sig = [], [], []
            for value in batch.column(1):
                own = shingles(value.as_py(), words)
                n.append(len(own))
                cls.append(class_of(own) if len(own) else None)
                sig.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary())], names=["k", "n", "cls", "sig"])
        forget()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(rows, f"k {kind}, n long, cls long, sig binary")


def banded(classes: DataFrame) -> DataFrame:
    """bucket, cls: a row for each band of each class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), dtype=np.uint32).reshape(-1, BANDS, ROWS)
                mixed = np.broadcast_to(salt, sig.shape[:2]).copy()
                for i in range(ROWS):
                    mixed = (mixed ^ sig[:, :, i]) * _FACTOR
                    mixed ^= mixed >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64).ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["bucket", "cls"])

    return classes.select("cls", "sig").mapInArrow(rows, "bucket long, cls long")


def pruned(threshold: int):
    """Which pairs no look at their signatures drops."""
    looks = [(at + STEP, least_matches(at + STEP, threshold / 100, MISS)) for at in range(0, BANDS * ROWS, STEP)]

    def prune(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, *_sizes) -> np.ndarray:
        left, right = left.view(np.uint32), right.view(np.uint32)
        live, equal = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
        for upto, fewest in looks:
            equal[live] += (left[i[live], upto - STEP : upto] == right[j[live], upto - STEP : upto]).sum(axis=1)
            live = live[equal[live] >= fewest]
        return live

    return prune


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """key, n_shingles, component_id, kept for every row of docs."""
    rows = materialize(signed(docs, key, text, words), "near-signed")
    classes = materialize(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("k").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-classes")
    multi = met(banded(classes))
    sketches = materialize(classes.join(multi.select("cls").distinct(), "cls", "left_semi"), "near-sketches")
    fetch = lambda wanted: sets_of(docs, wanted, key, text, lambda t: shingles(t, words), forget)
    comp = connect(multi, sketches, fetch, threshold, pruned(threshold), LEAST_BANDS)
    return resolved(rows, classes, comp, key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))

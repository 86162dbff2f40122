"""Exact Jaccard join of documents on word n-grams, size-aware: subsets of small sets, inverted lists of large ones.

Texts become sets of 64-bit hashes of their n-grams; texts with equal sets form
a class, and classes are joined. Elements have one order for all sets, rare ones
first: by the load of their cell in a table of ``CELLS`` counts over all
documents, then by hash. Any fixed order gives the same links; this one keeps
common passages out of the way. Of two sets that reach the threshold the larger,
of n elements, shares at least ``ceil(threshold * n / 100)`` with the other, so for any k
both have k elements in common among their first
``n - ceil(threshold * n / 100) + k``:

* (pruning) A set of whose first elements, with k = ``ahead(n)``, fewer than k
  stand in any other set's first elements links with none. Most texts that only
  share a passage with others end here.
* (heavy, k = 1) Large sets meet in the inverted lists of their first elements.
* (light, k = 2) Small sets meet in buckets of the two-element subsets of their
  first elements, which are far fewer sets each than the lists. An element in no
  other set's list is in no shared subset, so only subsets of the others are
  enumerated.

A pair of small sets meets in a subset, any other pair in a list; sets that are
small, but could still link with a large one, are in both. The boundary has the
least cost, with the enumerated subsets and the scanned lists counted by size.
``linking.connect`` finds the links of all buckets by contracting rounds and a
closing one; it compares parity bitmaps (each element flips one bit: the bits in
which two bitmaps differ never outnumber the elements in which the sets differ,
so no link is lost) and then full sets.

Null texts and texts without words have empty sets and link with nothing. Texts
with fewer words than an n-gram are one element. Repeated rows and equal keys
are kept, each with its result. Rows with null keys link like all others but
give no component its id: it is null where a component has no other keys. An
empty table gives an empty result, and further columns of the input are
ignored. Texts of any length are taken whole, part by part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_filter, materialize, maybe_in, release, table, text_or_empty
from .linking import class_of, connect, met, resolved, sets_of

WORDS, THRESHOLD = 5, 80
#: Counts that order elements. Cells get so many elements each that their loads differ little, but for those with common ones.
CELLS = 1 << 20
#: Sets that may count as small, at most: one has some 850 subsets at that size.
SMALL = 200
#: Cost of a row in a bucket (shuffles, joins), and of another set in its list.
ROW, SCAN = 100, 1
#: Bits of a parity bitmap.
BITS = 2048
#: Bytes of a text that are hashed at a time.
PART = 1 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers spread over 64 bits."""
    x = (x + np.uint64(1)) * _FACTOR
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(256, dtype=np.uint64) + np.uint64(1 << 40))
_PLACE = _mixed(np.arange(4096, dtype=np.uint64)) | np.uint64(1)


def _factors(places: np.ndarray) -> np.ndarray:
    if places.max(initial=0) < len(_PLACE):
        return _PLACE[places]
    return _mixed(places.astype(np.uint64)) | np.uint64(1)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each run of bytes that aren't white space: sums of a number by byte times a number by place in the word, mixed."""
    out: list[np.ndarray] = []
    held, size = np.zeros(1, dtype=np.uint64), 0  # sum and bytes of a word that goes on in the next part
    for at in range(0, len(data), PART):
        own = np.frombuffer(data, dtype=np.uint8, count=min(PART, len(data) - at), offset=at)
        letters = np.flatnonzero(~_SPACE[own])
        goes_on = bool(size) and len(letters) > 0 and letters[0] == 0
        if size and not goes_on:
            out.append(held)
            size = 0
        if not len(letters):
            continue
        first = np.flatnonzero(np.concatenate([[True], np.diff(letters) != 1]))
        place = np.arange(len(letters)) - np.repeat(first, np.diff(np.append(first, len(letters))))
        if goes_on:
            place[: first[1] if len(first) > 1 else len(place)] += size
        sums = np.add.reduceat(_BYTE[own[letters]] * _factors(place), first)
        if goes_on:
            sums[:1] += held
        size = 0
        if letters[-1] == len(own) - 1:
            held, size, sums = sums[-1:].copy(), int(place[-1]) + 1, sums[:-1]
        out.append(sums)
    if size:
        out.append(held)
    return _mixed(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def elements(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the text's distinct n-grams."""
    codes = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(codes):
        return codes
    span = min(words, len(codes))
    total = np.full(len(codes) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        total = (total ^ codes[i : len(codes) - span + 1 + i]) * _FACTOR
        total ^= total >> np.uint64(29)
    return np.unique(total)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def loads(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """How many elements of all documents fall into each cell."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(CELLS, dtype=np.int64), [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(_cell(elements(value.as_py(), words)))
                size += len(held[-1])
                if size >= CELLS:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])
        release()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), dtype=np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    # a table of its own, so that tasks of the second pass are as many as its bytes need
    each = materialize(docs.select(text_or_empty(text).alias("t")).mapInArrow(counts, "counts binary"), "join-counts")
    got = each.mapInArrow(sums, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, dtype=np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def fewest(n, threshold: int):
    """Elements that a set of n shares at least with any set it links with that isn't larger."""
    return (threshold * n + 99) // 100


def ahead(n, threshold: int):
    """Elements of the first ones that sets of n are asked to share."""
    return 1 + (n - fewest(n, threshold)) // 2


def prefixes(docs: DataFrame, key: str, text: str, words: int, threshold: int) -> DataFrame:
    """k, n, cls (null for empty sets), first: the first elements in the common order, as many as pruning needs; sig: the parity bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(loads(docs, text, words))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = shared.value
        for batch in batches:
            n, cls, first, sig = [], [], [], []
            for value in batch.column(1):
                own = elements(value.as_py(), words)
                n.append(len(own))
                cls.append(class_of(own) if len(own) else None)
                order = np.lexsort((own, load[_cell(own)]))[: len(own) - fewest(len(own), threshold) + max(2, ahead(len(own), threshold))]
                first.append(own[order].view(np.int64))
                sig.append(parity(own))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate(first))) if first else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), lists, pa.array(sig, pa.binary())], names=["k", "n", "cls", "first", "sig"])
        release()

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(rows, f"k {kind}, n long, cls long, first array<long>, sig binary")
    out = materialize(out, "join-prefixes")
    shared.destroy()  # the table needs it no more, and every executor holds a copy
    return out


def boundary(lists: DataFrame, threshold: int) -> int:
    """The size up to which sets are small, from lists (bucket, cls, n, extra, members): where subsets and scans cost least together."""
    own = lists.groupBy("cls", "n").agg(F.count("*").alias("m"), F.sum(F.when(F.col("extra"), 0).otherwise(ROW + SCAN * F.col("members"))).alias("scan"))
    light = ROW * F.col("m") * (F.col("m") - 1) / 2
    sizes = own.groupBy(F.least("n", F.lit(SMALL + 1)).alias("size")).agg(F.sum(light).alias("light"), F.sum("scan").alias("scan")).collect()
    subsets, scans = np.zeros(SMALL + 2), np.zeros(SMALL + 2)
    for r in sizes:
        subsets[r["size"]], scans[r["size"]] = r["light"], r["scan"]
    cost = [subsets[: b + 1].sum() + scans[fewest(b + 1, threshold) :].sum() for b in range(1, SMALL + 1)]
    return 1 + int(np.argmin(cost))


def subsets(small: DataFrame) -> DataFrame:
    """bucket, cls: a row for each two elements of each set, of small (cls, own: elements)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cls, keys = [], []
                for c, own in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256), strict=True):
                    values = np.sort(own.values.to_numpy().view(np.uint64))
                    i, j = np.triu_indices(len(values), 1)
                    keys.append((_mixed(values[i]) ^ values[j]) * _FACTOR)
                    cls.append(np.full(len(i), c))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cls))], names=["bucket", "cls"])

    return small.mapInArrow(rows, "bucket long, cls long")


def parity(own: np.ndarray) -> bytes:
    """A bitmap in which each element flips the bit that its hash names."""
    at = (own & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=BITS) & 1).tobytes()


def pruned(threshold: int):
    """Which pairs differ in so few bits that they may reach the threshold."""

    def prune(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
        left, right = left.view(np.uint64), right.view(np.uint64)
        total = n_left[i] + n_right[j]
        apart = total - 2 * -(-threshold * total // (100 + threshold))
        differ = np.zeros(len(i), dtype=np.int64)
        for at in range(0, len(i), 1 << 14):
            part = slice(at, at + (1 << 14))
            differ[part] = np.bitwise_count(left[i[part]] ^ right[j[part]]).sum(axis=1, dtype=np.int64)
        return np.flatnonzero(differ <= apart)

    return prune


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """key, n_shingles, component_id, kept for every row of docs."""
    rows = prefixes(docs, key, text, words, threshold)
    classes = materialize(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("k").alias("rep"), F.first("n").alias("n")), "join-classes")
    # sets of so few elements that one more or less falls short of the threshold link with equal ones only
    able = rows.where(100 * F.col("n") >= threshold * (F.col("n") + 1))
    each = able.select("cls", "n", F.posexplode("first").alias("at", "bucket"))
    # elements of several rows, be they of one class or not; from then on each is there once for a class
    crowded = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    bits = key_filter(materialize(crowded, "join-crowded"), "bucket")
    held = maybe_in(each, bits, "bucket").groupBy("cls", "bucket").agg(F.first("n").alias("n"), F.first("at").alias("at"))
    held = materialize(held, "join-held")
    bits.destroy()
    several = materialize(held.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "join-several")
    shared = materialize(held.join(several, "bucket", "left_semi"), "join-shared")
    need = F.expr(f"({threshold} * n + 99) div 100")
    least = 1 + F.floor((need - F.floor((threshold * need + 99) / 100)) / 2)  # what is asked of the smallest set that n can link with
    likely = materialize(shared.groupBy("cls", "n").agg(F.count("*").alias("m")).where(F.col("m") >= least).select("cls"), "join-likely")
    lists = shared.join(likely, "cls", "left_semi").withColumn("extra", F.col("at") >= F.col("n") - need + 1)
    lists = met(lists.where(~F.col("extra") | ((F.col("n") <= SMALL) & (F.col("at") == F.col("n") - need + 1))).select("bucket", "cls", "n", "extra"), "n", "extra")
    small = boundary(lists, threshold)
    light = subsets(lists.where(F.col("n") <= small).groupBy("cls").agg(F.collect_list("bucket").alias("own")).where(F.size("own") > 1))
    heavy = lists.where((F.col("n") >= fewest(small + 1, threshold)) & ~F.col("extra")).select("bucket", "cls")
    multi = met(light.unionByName(heavy))
    needed = materialize(classes.join(multi.select("cls").distinct(), "cls", "left_semi"), "join-needed")
    bits = key_filter(needed, "cls")
    drawn = maybe_in(rows.where("cls IS NOT NULL").select("cls", "sig"), bits, "cls").groupBy("cls").agg(F.first("sig").alias("sig"))
    sketches = materialize(needed.join(drawn, "cls"), "join-sketches")
    bits.destroy()
    fetch = lambda wanted: sets_of(docs, wanted, key, text, lambda t: elements(t, words), release)
    return resolved(rows, classes, connect(multi, sketches, fetch, threshold, pruned(threshold)), key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("kept")

"""Packing of documents into sequences by cutting-stock column generation.

1. Each document's codes, with the closing code, are cut in chunks of the full
   length; the rest is cut at the largest multiple of ``grain``. What remains, a
   tail of fewer than ``grain`` codes, is kept apart.
2. The histogram of main lengths (at most length / grain - 1 classes, however
   many documents there are) goes to the driver. A linear program over patterns
   of classes that fit a sequence is solved by column generation: the simplex
   method over the patterns so far, and a knapsack dynamic program that prices
   new ones from the dual values. Pattern counts are rounded down; what is left
   of each class is laid out by first-fit-decreasing patterns, so that slots and
   pieces agree exactly.
3. Pieces are ranked in their class: by hash buckets, with running offsets over
   bucket counts and over spans of buckets, so that no task sees a whole class. A rank alone tells a
   piece's sequence and place.
4. Tails run on as one stream of codes through the gaps that patterns leave and
   then through further sequences; the last ones have powers of two as lengths,
   which need no padding. A tail is cut where a gap ends.

Null texts count as empty and still carry the closing code. Repeated rows are
packed each on its own, an empty table gives no rows, and further columns of
the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table, text_or_empty
from .wordcodes import forget, library

LENGTH, GRAIN, END = 4096, 64, 2
#: Rows in a ranking bucket, on average.
BUCKET_ROWS = 20_000
#: Buckets whose running sums one task takes together.
SPAN = 64
#: Rows of a batch that cutting passes on, or a little more.
ROWS = 4096


def cut(docs: DataFrame, tokenizer: str, length: int, grain: int, end: int, key: str, text: str) -> DataFrame:
    """Rows key, start, length, ids_crc32, doc_tokens, class (0: tail, length / grain: a whole sequence), ids of tails."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library(tokenizer, "ids")
        closing = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows = Rows()
            for at, ids in enumerate(words.whole(batch.column(1))):
                rows.add(at, ids + closing, length, grain)
                if len(rows) >= ROWS:
                    yield rows.batch(batch.column(0))
                    rows = Rows()
            if len(rows):
                yield rows.batch(batch.column(0))
        forget()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(pieces, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, ids binary")


class Rows:
    """Pieces on their way to Arrow: numbers in arrays, codes of tails in one buffer."""

    def __init__(self):
        self.numbers, self.tails, self.ends = array("q"), bytearray(), array("i", [0])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def add(self, at: int, ids: bytes, length: int, grain: int) -> None:
        total, start = len(ids) // 4, 0
        while start < total:
            left = total - start
            size = length if left >= length else left // grain * grain or left
            own = ids[4 * start : 4 * (start + size)]
            self.numbers.extend((at, start, size, zlib.crc32(own), total, size // grain if size >= grain else 0))
            if size < grain:
                self.tails += own
            self.ends.append(len(self.tails))
            start += size

    def batch(self, keys: pa.Array) -> pa.RecordBatch:
        at, start, size, crc, total, kind = np.frombuffer(self.numbers, dtype=np.int64).reshape(-1, 6).T
        tails = pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.ends.tobytes()), pa.py_buffer(bytes(self.tails))])
        columns = [keys.take(pa.array(at)), *(pa.array(x.copy()) for x in (start, size, crc, total)), pa.array(kind.astype(np.int32)), tails]
        return pa.RecordBatch.from_arrays(columns, names=["k", "start", "length", "ids_crc32", "doc_tokens", "class", "ids"])


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the most valuable multiset of sizes within capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room], took[room] = best[room - 1], -1
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            worth = values[fits] + best[room - sizes[fits]]
            k = int(worth.argmax())
            if worth[k] > best[room] + 1e-12:
                best[room], took[room] = worth[k], fits[k]
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), pattern


def relaxed(demand: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns with counts that cover the demand with the fewest sequences, fractions allowed."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # a column for each pattern
    counts = demand / np.diag(basis)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(m))
        worth, pattern = best_pattern(np.maximum(dual, 0), sizes, capacity)
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        up = np.flatnonzero(step > 1e-9)
        if not len(up):
            break
        leaves = up[np.argmin(counts[up] / step[up])]
        basis[:, leaves] = pattern
        counts = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    return [(np.rint(basis[:, j]).astype(np.int64), float(counts[j])) for j in range(m)]


def layout(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern: class to number, how often), with exactly demand[class] slots of each class in all."""
    classes = sorted((c for c, n in demand.items() if n), reverse=True)
    if not classes:
        return []
    sizes, left = np.array(classes), np.array([demand[c] for c in classes], dtype=np.int64)
    found: list[tuple[dict[int, int], int]] = []

    def put(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        used = pattern > 0
        times = int(min(times, (left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            left = left - pattern * times
            found.append(({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(used)}, times))

    for pattern, count in sorted(relaxed(left, sizes, capacity), key=lambda x: -x[1]):
        put(pattern, math.floor(count + 1e-6))
    while left.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for i in range(len(sizes)):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        put(pattern, int(left.max()))
    return found


class Plan:
    """Places by arithmetic on ranks; its size depends on the number of classes only."""

    def __init__(self, demand: dict[int, int], tail_codes: int, length: int, grain: int):
        self.length, self.grain, top = length, grain, length // grain
        #: class -> rows (first rank, slots in the pattern, first sequence, offset of its slots)
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {}
        #: rows (first place in the tails' stream, gap size, first sequence, offset in the sequence, 1 or 0: whether each gap is a sequence of its own)
        gaps: list[tuple[int, int, int, int]] = []
        given: dict[int, int] = {}
        sequence = place = 0
        for pattern, times in layout(demand, top):
            offset = 0
            for c, n in sorted(pattern.items(), reverse=True):
                self.slots.setdefault(c, []).append((given.get(c, 0), n, sequence, offset))
                given[c] = given.get(c, 0) + n * times
                offset += c * n * grain
            if offset < length:
                gaps.append((place, length - offset, sequence, offset))
                place += (length - offset) * times
            sequence += times
        if place < tail_codes:
            whole = (tail_codes - place) // length
            if whole:
                gaps.append((place, length, sequence, 0))
                place, sequence = place + whole * length, sequence + whole
            for size in (1 << k for k in range(length.bit_length() - 1, -1, -1)):
                if tail_codes - place >= size:
                    gaps.append((place, size, sequence, 0))
                    place, sequence = place + size, sequence + 1
        self.gaps = np.array(gaps, dtype=np.int64).reshape(-1, 4)
        self.sequences = sequence

    def put(self, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(kind), dtype=np.int64), np.zeros(len(kind), dtype=np.int64)
        for c in np.unique(kind):
            own = kind == c
            rows = np.array(self.slots[int(c)], dtype=np.int64)
            first, n, seq, off = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1].T
            within = rank[own] - first
            sequence[own], offset[own] = seq + within // n, off + within % n * c * self.grain
        return sequence, offset

    def run(self, place: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(codes before, codes, sequence, offset) of the pieces of the stream from place on."""
        done = 0
        while done < size:
            first, gap, sequence, offset = map(int, self.gaps[np.searchsorted(self.gaps[:, 0], place + done, "right") - 1])
            n, within = divmod(place + done - first, gap)
            take = min(size - done, gap - within)
            yield done, take, sequence + n, offset + within
            done += take


def running(own: DataFrame) -> DataFrame:
    """bucket, class, before: the sum of the class's amounts in all buckets before, of own (bucket, class, amount).

    Sums run within spans of buckets and over the spans' totals, so no task sees all buckets of a class.
    """
    own = own.withColumn("span", F.floor(F.col("bucket") / SPAN))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    totals = own.groupBy("class", "span").agg(F.sum("amount").alias("total"))
    totals = totals.select("class", "span", none(F.sum("total").over(earlier("class").orderBy("span"))).alias("spans_before"))
    inside = own.withColumn("inside", none(F.sum("amount").over(earlier("class", "span").orderBy("bucket"))))
    return inside.join(totals, ["class", "span"]).select("bucket", "class", (F.col("inside") + F.col("spans_before")).alias("before"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, grain: int = GRAIN, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    found = materialize(cut(docs, tokenizer, length, grain, end, key, text), "packing")
    rows = found.count()
    buckets = max(math.ceil(rows / BUCKET_ROWS), 8 * shuffle_partitions(spark), 1)
    pieces = found.withColumn("bucket", F.pmod(F.xxhash64("k", "start", "ids_crc32"), F.lit(buckets)))
    own = pieces.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.sum("length").alias("codes"))
    own = materialize(own, "packing-counts")
    totals = {r["class"]: (r["n"], r["codes"]) for r in own.groupBy("class").agg(F.sum("n").alias("n"), F.sum("codes").alias("codes")).collect()}
    plan = Plan({c: n for c, (n, _) in totals.items() if c}, totals.get(0, (0, 0))[1], length, grain)
    offsets = running(own.select("bucket", "class", F.when(F.col("class") == 0, F.col("codes")).otherwise(F.col("n")).alias("amount")))
    inside = Window.partitionBy("bucket", "class").orderBy("k", "start", "ids_crc32", "length", "doc_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.join(offsets, ["bucket", "class"]).withColumn("rank", F.col("before") + F.coalesce(F.sum(F.when(F.col("class") == 0, F.col("length")).otherwise(1)).over(inside), F.lit(0)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column(5).to_numpy(), batch.column(7).to_numpy()
            main = np.flatnonzero(kind > 0)
            sequence, offset = plan.put(kind[main], rank[main])
            start, size, crc, total = (batch.column(i).to_numpy() for i in range(1, 5))
            out = [(main, start[main], size[main], crc[main], total[main], sequence, offset)]
            tails = np.flatnonzero(kind == 0)
            rows = []
            for i, place, ids in zip(tails.tolist(), rank[tails].tolist(), batch.column(6).take(pa.array(tails)).to_pylist(), strict=True):
                for done, take, seq, off in plan.run(place, int(size[i])):
                    rows.append((i, int(start[i]) + done, take, zlib.crc32(ids[4 * done : 4 * (done + take)]), int(total[i]), seq, off))
            if rows:
                out.append(tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)))
            joined = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(joined[0])), *(pa.array(x.astype(np.int64)) for x in joined[1:])], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    out = ranked.select("k", "start", "length", "ids_crc32", "doc_tokens", "class", "ids", "rank")
    return out.mapInArrow(placed, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

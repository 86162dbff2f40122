"""Repeated byte strings by longest-previous-factor arrays over suffix arrays.

A string of ``length`` bytes that starts at two places is found in three steps:

1. Every window of that length has an anchor: the leftmost least hash of its
   ``GRAM``-byte strings. Equal windows have equal anchors at equal places, so
   only windows of the same anchor need comparing. Windows with one anchor that
   follow one another make a segment; a segment's bytes are hashed whole.
2. Anchors that occur once are dropped. Equal segments are counted before
   anything else, so copies of whole documents cost one representative. For
   anchors with several different segments the representatives' bytes are
   fetched, and the segments of each anchor are joined, in document order, to
   one text. Its suffix array comes from prefix doubling, the lengths of common
   prefixes from the ranks at each doubling, and previous and next smaller
   positions in suffix order give the longest previous factor; the mirrored
   arrays give the longest factor that comes again later.
3. An anchor with more than ``CROWDED`` segments (a passage in very many
   documents) would make an unbounded text. Its windows are hashed one by one
   and counted instead, which is exact too and splits over all tasks.

``keep="first"`` removes what also starts earlier (by key, then position),
``keep="none"`` all copies. Strings never cross texts; null texts are empty.
Rows that are wholly equal, key included, are copies of one another and get
equal results; null keys are keys. Texts of any length go in chunks, an empty
table gives an empty result, and further columns are ignored unless carried,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_filter, materialize, maybe_in, release, table, text_or_empty

LENGTH, GRAM, CROWDED, STRETCH = 200, 40, 512, 16
#: Bytes hashed together, and symbols of a suffix array's text.
LOT, TEXT = 1 << 18, 1 << 18

_RNG = np.random.default_rng(77_041)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = 0x9E3779B97F4A7C15 | 1


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the size bytes from each place on."""
    out, done = None, 0
    part, span = _BYTE[data], 1
    left = size
    while left:
        if left & 1:
            out = part[: len(data) - size + 1] if out is None else out[: len(data) - size + 1] * np.uint64(pow(_POWER, span, 1 << 64)) + part[done : done + len(data) - size + 1]
            done += span
        left >>= 1
        if left:
            part = part[:-span] * np.uint64(pow(_POWER, span, 1 << 64)) + part[span:]
            span *= 2
    out = out ^ out >> np.uint64(31)
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(32)


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    span, out = 1, values
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = size - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Arrays text, start, end (of window starts, inclusive), anchor, segment hash."""
    found: list[tuple[np.ndarray, ...]] = []
    lot: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not lot:
            return
        joined = b"".join(x for _, _, x in lot)
        data, sizes = np.frombuffer(joined, dtype=np.uint8), np.array([len(x) for _, _, x in lot])
        hashes = rolling(data, gram)
        packed = (hashes & np.uint64(~0xFFFFF & (1 << 64) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (sliding_least(packed, length - gram + 1) & np.uint64(0xFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(lot)), sizes)
        n = len(data) - length + 1
        whole = owner[:n] == owner[length - 1 :]
        new = np.ones(n, dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:n] != owner[: n - 1])
        starts = np.flatnonzero(whole & new)
        last = np.ones(n, dtype=bool)
        last[:-1] = new[1:] | ~whole[1:]
        ends = np.flatnonzero(whole & last)
        view = memoryview(joined)
        seg = np.fromiter((xxhash.xxh3_64_intdigest(view[s : e + length]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
        base = np.cumsum(sizes) - sizes - np.array([b for _, b, _ in lot])
        place = owner[starts]
        found.append((np.array([t for t, _, _ in lot])[place], starts - base[place], ends - base[place], hashes[anchor[starts]].view(np.int64), seg.view(np.int64)))
        lot.clear()
        held = 0

    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), LOT):
            lot.append((i, at, text[at : at + LOT + length - 1]))
            held += len(lot[-1][2])
            if held >= LOT:
                flush()
    flush()
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Suffixes:
    """Suffix order of a text of small numbers, to a depth of at least ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        n, self.ranks = len(text), []
        key, span = text.astype(np.int64) + 1, 1
        if key.max(initial=0) < 1 << 15:  # pairs and fours of small symbols are numbers without sorting
            while span < min(depth, 4):
                self.ranks.append((span, np.append(key, 0)))
                key = (key << 15 * span) + np.append(key[span:], np.zeros(min(span, n), dtype=np.int64))
                span *= 2
        # a rank is the place of the first of its equals; only suffixes that have equals are sorted again
        rank, open_ = np.ones(n, dtype=np.int64), np.arange(n)
        while True:
            by = np.argsort(key)
            step, own, at = key[by], rank[open_[by]], np.arange(len(by))
            first = np.ones(len(by), dtype=bool)
            first[1:] = step[1:] != step[:-1]
            group = np.ones(len(by), dtype=bool)
            group[1:] = own[1:] != own[:-1]
            rank[open_[by]] = own + np.maximum.accumulate(at * first) - np.maximum.accumulate(at * group)
            self.ranks.append((span, np.append(rank, 0)))
            alone = first & np.append(first[1:], True)
            open_ = open_[by[~alone]]
            if span >= depth or not len(open_):
                break
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: n - span] = rank[span:]
            key = rank[open_] * (n + 1) + ahead[open_]
            span *= 2
        self.order = np.argsort(rank * n + np.arange(n))
        self.n = n
        self.near = self.common(self.order[:-1], self.order[1:])  # of neighbours in suffix order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes, to twice the depth."""
        out = np.zeros(len(a), dtype=np.int64)
        for span, rank in reversed(self.ranks):
            x, y = np.minimum(a + out, self.n), np.minimum(b + out, self.n)
            out += np.where((rank[x] == rank[y]) & (x < self.n) & (y < self.n), span, 0)
        return out


def factors(text: np.ndarray, least: int, later: bool = False, suffixes: Suffixes | None = None) -> np.ndarray:
    """Longest previous factor at each place (with later, the longest factor that starts again further on); lengths under least count as 0, and longer ones are told from it only."""
    suffixes = suffixes or Suffixes(text, least)
    order, near, n = suffixes.order, suffixes.near, len(text)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    position = -order if later else order
    for turned in (False, True):  # the previous smaller position in suffix order, then the next one
        pos = position[::-1] if turned else position
        length = np.concatenate([[0], near[::-1] if turned else near])
        jump = np.arange(n) - 1
        jump[length < least] = -1
        while True:
            on = np.flatnonzero(jump >= 0)
            on = on[pos[jump[on]] > pos[on]]
            if not len(on):
                break
            over = jump[on]
            length[on] = np.minimum(length[on], length[over])
            jump[on] = np.where(jump[over] >= 0, jump[over], -1)
            jump[on[length[on] < least]] = -1
        length = np.where(jump >= 0, length, 0)
        places = order[::-1] if turned else order
        out[places] = np.maximum(out[places], length)
    return out


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte runs that windows from those (sorted) starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), (starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length).tolist(), strict=True))


RUNS = "array<struct<from:int,to:int>>"
_RUN_TYPE = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _within(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The run without the characters that it covers in part."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _pairs(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"from": a, "to": b} for a, b in r] for r in rows], _RUN_TYPE)


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """k, th, anchor, seg, start, end of each segment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                stop, size = at, 0
                while stop < batch.num_rows and size < 16 * LOT:
                    size += len(batch.column(2)[stop].as_buffer() or b"")
                    stop += 1
                part = batch.slice(at, stop - at)
                text, start, end, anchor, seg = segments([x.as_py() for x in part.column(2)], length, gram)
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(anchor), pa.array(seg), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["k", "th", "anchor", "seg", "start", "end"])
                at = stop
        release()

    kind = docs.schema["k"].dataType.simpleString()
    return docs.mapInArrow(rows, f"k {kind}, th long, anchor long, seg long, start int, end int")


def contexts(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes of chosen segments (anchor, seg, n, m, k, th, start, end)."""
    wanted = chosen.groupBy("k", "th").agg(F.collect_list(F.struct("anchor", "seg", "n", "m", "start", "end")).alias("own"))
    wanted = materialize(wanted, "suffix-wanted")
    texts = maybe_in(docs, key_filter(wanted, "k", "th"), "k", "th").alias("d")
    joined = texts.join(wanted.alias("w"), F.expr("d.k <=> w.k AND d.th = w.th")).select("d.k", "d.t", "w.own")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat = part.column(2).flatten()
                if not len(flat):
                    continue
                parent = pa.compute.list_parent_indices(part.column(2))
                texts_ = part.column(1)
                names = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
                last, whole, data = -1, b"", []
                for p, s, e in zip(parent.to_pylist(), names["start"].to_pylist(), names["end"].to_pylist(), strict=True):
                    if p != last:
                        last, whole = p, texts_[p].as_py()
                    data.append(whole[s : e + length])
                yield pa.RecordBatch.from_arrays([names["anchor"], names["seg"], names["n"], names["m"], part.column(0).take(parent), names["start"], pa.array(data, pa.binary())], names=["anchor", "seg", "n", "m", "k", "start", "data"])

    kind = docs.schema["k"].dataType.simpleString()
    found = joined.mapInArrow(rows, f"anchor long, seg long, n long, m long, k {kind}, start int, data binary")
    return materialize(found, "suffix-contexts")


def by_factors(segs: DataFrame, length: int, keep: str) -> DataFrame:
    """anchor, seg, runs: what the factor arrays find in the representatives."""

    def solve(group: list[tuple]) -> Iterator[tuple]:
        sizes = [len(x[2]) for x in group]
        joined = np.frombuffer(b"".join(x[2] for x in group), dtype=np.uint8).astype(np.int64)
        text = np.empty(len(joined) + len(group), dtype=np.int64)
        ends = np.cumsum(np.array(sizes) + 1) - 1
        mask = np.ones(len(text), dtype=bool)
        mask[ends] = False
        text[mask], text[~mask] = joined, 256 + np.arange(len(group))  # each border a symbol of its own
        suffixes = Suffixes(text, length)
        found = factors(text, length, suffixes=suffixes) >= length
        if keep == "none":  # the mirrored arrays come from the same suffix order
            found |= factors(text, length, later=True, suffixes=suffixes) >= length
        at = 0
        for (anchor, seg, _, _), size in zip(group, sizes, strict=True):
            yield anchor, seg, covered(np.flatnonzero(found[at : at + size]), length)
            at += size + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size = 0

        def out(solved: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in solved], pa.int64()), pa.array([x[1] for x in solved], pa.int64()), _pairs([x[2] for x in solved])], names=["anchor", "seg", "runs"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if size >= TEXT and row[0] != group[-1][0]:
                    yield out(list(solve(group)))
                    group, size = [], 0
                group.append(row)
                size += len(row[2])
        if group:
            yield out(list(solve(group)))
        release()

    placed = segs.select("anchor", "seg", "data", "n", "k", "start").repartition("anchor").sortWithinPartitions("anchor", "k", "start")
    return placed.select("anchor", "seg", "data", "n").mapInArrow(rows, f"anchor long, seg long, runs {RUNS}")


def by_windows(segs: DataFrame, length: int, keep: str, gram: int) -> DataFrame:
    """The same for crowded anchors, by counting hashes: first of stretches of ``STRETCH`` windows, then of single windows.

    Stretches start at fixed distances from the anchor, so those inside a
    passage are equal in all segments and settled at once. Of equal stretches
    one goes on. The bytes that all windows of a stretch share are its core;
    equal windows have equal cores, so only windows of stretches with one core
    are hashed one by one: those at a passage's edges.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own, offs, sizes, subs, cores, cut = [], [], [], [], [], []
                for i, value in enumerate(part.column(5)):
                    data = value.as_py()
                    n = len(data) - length + 1
                    hashes = rolling(np.frombuffer(data[:length], dtype=np.uint8), gram) & np.uint64(~0xFFFFF & (1 << 64) - 1)
                    first = 0
                    end = int(hashes.argmin()) % STRETCH + 1  # windows up to a multiple of STRETCH before the anchor
                    while first < n:
                        stop = min(end, n)
                        text = data[first : stop - 1 + length]
                        own.append(i)
                        offs.append(first)
                        sizes.append(stop - first)
                        subs.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
                        cores.append(xxhash.xxh3_64_intdigest(data[end - 1 : max(end - STRETCH + length, 0)]) - (1 << 63))
                        cut.append(text)
                        first, end = stop, end + STRETCH
                places = pa.array(own)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(places) for c in range(5)), pa.array(offs, pa.int32()), pa.array(sizes, pa.int32()), pa.array(subs, pa.int64()), pa.array(cores, pa.int64()), pa.array(cut, pa.binary())], names=["anchor", "seg", "n", "k", "start", "off", "size", "sub", "core", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                lists = [rolling(np.frombuffer(x.as_py(), dtype=np.uint8), length) for x in part.column(6)]
                own = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in lists]))
                offs = part.column(5).take(own).to_numpy() + np.concatenate([np.arange(len(x), dtype=np.int32) for x in lists])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(own) for c in range(5)), pa.array(offs.astype(np.int32)), pa.array(np.concatenate(lists).view(np.int64))], names=["anchor", "seg", "n", "k", "start", "off", "window"])

    kind = segs.schema["k"].dataType.simpleString()
    place = F.struct("k", (F.col("start") + F.col("off")).alias("at"))
    is_first = F.expr("first.k <=> k AND first.at = start + off")
    cut = segs.select("anchor", "seg", "n", "k", "start", "data").mapInArrow(stretches, f"anchor long, seg long, n long, k {kind}, start int, off int, size int, sub long, core long, text binary")
    # tables, so that neither side of a join is computed twice or stands above a sum by the join's key: Spark can split the rows of a common passage
    cut = materialize(cut, "suffix-cut")
    equal = materialize(cut.groupBy("anchor", "sub").agg(F.sum("n").alias("total"), F.min(place).alias("first"), F.first("core").alias("core")), "suffix-equal")
    shared = materialize(equal.groupBy("anchor", "core").agg(F.count("*").alias("stretches")).where("stretches > 1").select("anchor", "core", F.lit(True).alias("shared")), "suffix-cores")
    equal = materialize(equal.join(shared, ["anchor", "core"], "left").drop("core"), "suffix-met")
    known = materialize(cut.join(equal, ["anchor", "sub"]), "suffix-stretches")
    settled = known.where((F.col("total") > 1) if keep == "none" else ~is_first)
    whole = settled.select("anchor", "seg", F.col("off").alias("from"), (F.col("off") + F.col("size") - 1 + length).cast("int").alias("to"))
    windows = known.where("shared").where(is_first).select("anchor", "seg", F.col("total").alias("n"), "k", "start", "off", "text").mapInArrow(hashed, f"anchor long, seg long, n long, k {kind}, start int, off int, window long")
    windows = materialize(windows, "suffix-windows")
    counts = windows.groupBy("anchor", "window").agg(F.sum("n").alias("total"), F.min(place).alias("first")).where("total > 1")
    counts = materialize(counts, "suffix-counts")
    if keep == "none":
        again = windows.where("n = 1").join(counts.select("anchor", "window"), ["anchor", "window"])
    else:
        again = windows.join(counts, ["anchor", "window"]).where(~is_first)
    single = again.select("anchor", "seg", F.col("off").alias("from"), (F.col("off") + length).cast("int").alias("to"))
    # at most length - gram + 1 windows share a segment
    return whole.unionByName(single).groupBy("anchor", "seg").agg(F.collect_set(F.struct("from", "to")).alias("runs"))


def repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", gram: int = GRAM) -> DataFrame:
    """k, th, runs: the repeated byte runs of docs (k, th, t), which may overlap or touch."""
    all_of = materialize(occurrences(docs, length, gram), "suffix-anchors")
    # counts are tables of their own, so that both sides of a join are plain shuffles and Spark can split the rows of a hot anchor
    shared = materialize(all_of.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "suffix-often")
    occ = materialize(all_of.join(shared, "anchor"), "suffix-shared")
    segs = materialize(occ.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("k", "th", "start", "end")).alias("first")), "suffix-segments")
    several = materialize(segs.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "suffix-several")
    chosen = segs.join(several, "anchor").select("anchor", "seg", "n", "m", "first.*")
    found = contexts(docs, chosen, length)
    partial = by_factors(found.where(F.col("m") <= CROWDED), length, keep).unionByName(by_windows(found.where(F.col("m") > CROWDED), length, keep, gram)).where(F.size("runs") > 0)
    whole = F.array(F.struct(F.lit(0).alias("from"), (F.col("end") - F.col("start") + length).alias("to"))).cast(RUNS)
    settled = materialize(segs.select("anchor", "seg", "n", "first").join(partial, ["anchor", "seg"], "left"), "suffix-settled")
    marked = occ.join(settled, ["anchor", "seg"])
    if keep == "none":
        runs = F.when(F.col("n") > 1, whole).otherwise(F.col("runs"))
    else:
        is_first = F.expr("first.k <=> k AND first.th = th AND first.start = start AND first.end = end")
        runs = F.when(~is_first, whole).otherwise(F.col("runs"))
    placed = marked.select("k", "th", "start", runs.alias("runs")).where("runs IS NOT NULL")
    return placed.select("k", "th", F.transform("runs", lambda r: F.struct((r["from"] + F.col("start")).alias("from"), (r["to"] + F.col("start")).alias("to"))).alias("runs"))


def removed(docs: DataFrame, length: int = LENGTH, keep: str = "first", key: str = "doc_id", text: str = "text", carry: list[str] | None = None, whole_chars: bool = False) -> DataFrame:
    """key (and the columns in carry), n_bytes, n_removed, n_spans, spans, kept (the remaining bytes) of every row.

    With whole_chars a run gives up the bytes of characters it covers in part, so kept stays UTF-8.
    """
    carry = [c for c in carry or [] if c != key]
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(key).alias("k"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)), text_or_empty(text).cast("binary").alias("t")).withColumn("th", F.xxhash64("t"))
    plain = rows.select("k", "th", "t")
    runs = repeats(plain, length, keep)
    of_doc = materialize(runs.groupBy("k", "th").agg(F.flatten(F.collect_set("runs")).alias("runs")), "suffix-runs")
    shared = key_filter(of_doc, "k", "th")
    some = maybe_in(rows, shared, "k", "th").alias("d").join(of_doc.alias("r"), F.expr("d.k <=> r.k AND d.th = r.th"), "left").select("d.k", *(f"d.{n}" for n in names), "d.t", "r.runs")
    rest = maybe_in(rows, shared, "k", "th", found=False).select("k", *names, "t", F.lit(None).cast(RUNS).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for data, own in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                whole, merged = data.as_py(), []
                for a, b in sorted((r["from"], r["to"]) for r in own or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1] = merged[-1][0], max(b, merged[-1][1])
                    else:
                        merged.append((a, b))
                if whole_chars:
                    merged = [x for x in (_within(whole, a, b) for a, b in merged) if x[0] < x[1]]
                spans.append(merged)
                edges = [0, *(x for run in merged for x in run), len(whole)]
                kept.append(b"".join(whole[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            front = [batch.column(i) for i in range(batch.num_columns - 2)]
            sizes = pa.array([len(x.as_buffer()) for x in batch.column(batch.num_columns - 2)], pa.int64())
            yield pa.RecordBatch.from_arrays([*front, sizes, _pairs(spans), pa.array(kept, pa.binary())], names=["k", *names, "n_bytes", "spans", "kept"])
        release()

    shape = ", ".join([f"k {docs.schema[key].dataType.simpleString()}", *(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, names, strict=True))])
    out = some.unionByName(rest).mapInArrow(cut, f"{shape}, n_bytes long, spans {RUNS}, kept binary")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])
    return out.select(F.col("k").alias(key), *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)), "n_bytes", total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed(table(spark, sf_dir, "documents"), keep="none")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

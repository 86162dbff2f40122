"""What the set joins share: classes of equal sets, buckets that bring candidates together, links confirmed on full sets, components.

No bucket ever emits all its pairs:

* Contracting rounds: each class is paired with the pivot that it meets in most
  buckets, then in each bucket one member of every component so far with the
  largest component's. A bucket's pivot is its most central member, the one
  that meets most others over all its buckets: among copies edited in different
  places that is the text they were made from. Pairs that hold merge
  components, so thousands of near copies cost about one pair each.
* A closing round over buckets that still hold several components: all classes
  of the buckets with one largest component form a family. Its members outside
  that component (any link between two components has such an end) are dealt
  in small blocks, and so are all its members. A first pass compares the
  sketches of two blocks as matrices and tells which members have a possible
  partner; a second one has only these, with their full sets, and emits links
  only, never candidates.

A bucket may hold a third of all classes. What is known of buckets (counts,
pivots, largest components) is written as a table before rows meet it, so both
sides of each join are plain shuffles and adaptive execution splits a hot
bucket's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_filter, materialize, maybe_in, text_or_empty
from .components import components

CONTRACTIONS = 2
#: Blocks of the closing round: members outside the largest component, all members, and elements in either.
OUTSIDE, INSIDE, ELEMENTS = 128, 512, 1 << 18
#: Bits of the filter that keeps texts without candidates out of the shuffle; its size never changes.
FILTER_BITS = 25
#: Sets that are passed on at a time.
PASSED = 500

#: (left sketches, right sketches, rows of the left, rows of the right, all sizes left, all sizes right) -> which of these pairs may reach the threshold
Prune = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]

#: Classes (cls, rep) -> their sets (cls, own: sorted hashes)
Fetch = Callable[[DataFrame], DataFrame]


def class_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def met(rows: DataFrame, *carry: str) -> DataFrame:
    """Rows (bucket, cls and what carry names) of buckets with several, with their number (members), as a table."""
    crowded = materialize(rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "link-crowded")
    shared = key_filter(crowded, "bucket")
    out = materialize(maybe_in(rows, shared, "bucket").join(crowded, "bucket").select("bucket", "cls", *carry, "members"), "link-buckets")
    shared.destroy()  # what is written needs it no more, and every executor holds a copy
    return out


def sets_of(docs: DataFrame, needed: DataFrame, key: str, text: str, elements: Callable[[str], np.ndarray], forget: Callable[[], None]) -> DataFrame:
    """cls, own (the set: sorted hashes) of the needed classes (cls, rep), from one text each, that of the representative.

    A filter of fixed size goes to all tasks and keeps most other texts out of
    this pass while few are needed; the join behind it decides.
    """
    size = 1 << FILTER_BITS
    spot = F.pmod(F.xxhash64("rep"), F.lit(size))
    filled = needed.groupBy(F.floor(spot / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int"))).alias("bits"))
    got = filled.toArrow()
    bits = np.zeros(size // 64, dtype=np.uint64)
    bits[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = np.flatnonzero(table_[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            for first in range(0, len(hit), PASSED):
                kept = batch.take(pa.array(hit[first : first + PASSED]))
                sets = [elements(x.as_py()) for x in kept.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(x) if len(x) else None for x in sets], pa.int64()), kept.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cls", "k", "own"])
        forget()

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"), F.pmod(F.xxhash64(key), F.lit(size)).alias("spot")).mapInArrow(rows, f"cls long, k {kind}, own binary")
    mine = needed.select(F.col("cls").alias("c"), "rep")
    return found.join(mine, F.expr("cls = c AND k <=> rep"), "left_semi").groupBy("cls").agg(F.first("own").alias("own"))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.uint8).reshape(len(column), -1)


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def survivors(pairs: DataFrame, sketches: DataFrame, threshold: int, prune: Prune) -> DataFrame:
    """Pairs that their sizes and sketches leave possible."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                every, sizes = np.arange(batch.num_rows), [batch.column(i).to_numpy() for i in (4, 5)]
                live = pa.array(prune(_sketches(batch.column(2)), _sketches(batch.column(3)), every, every, *sizes))
                yield pa.RecordBatch.from_arrays([batch.column(i).take(live) for i in (0, 1)], names=["a", "b"])

    sides = [sketches.select(F.col("cls").alias(c), F.col("n").alias("n" + c), F.col("sig").alias("s" + c)) for c in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold)
    return joined.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(rows, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = [linked(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            mask = pa.array(hold, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    sides = [sets.select(F.col("cls").alias(c), F.col("own").alias("o" + c)) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "oa", "ob").mapInArrow(rows, "a long, b long")


def _dealt(family: DataFrame, sets: DataFrame) -> DataFrame:
    """Families (top, cls, comp, n) in blocks (top, x, y): outer members (side 0) with inner ones (side 1), and what sets has of each."""
    out = F.col("comp") != F.col("top")
    share = lambda rows, elements, most: F.greatest(F.ceil(rows / most), F.ceil(elements / ELEMENTS)).cast("int")
    dealt = family.groupBy("top").agg(
        share(F.count(F.when(out, 1)), F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)), OUTSIDE).alias("outer"), share(F.count("*"), F.sum("n"), INSIDE).alias("inner")
    )
    placed = family.join(materialize(dealt, "link-blocks"), "top")  # two plain shuffles, so that a large family can be split
    mine = lambda blocks: F.pmod(F.xxhash64("cls"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    outer = placed.where(out).select("top", mine("outer").alias("x"), every("inner").alias("y"), F.lit(0).alias("side"), "cls", "comp", "n")
    inner = placed.select("top", every("outer").alias("x"), mine("inner").alias("y"), F.lit(1).alias("side"), "cls", "comp", "n")
    blocks = outer.unionByName(inner).join(sets, "cls").select("top", "x", "y", "side", "cls", "comp", "n", *(c for c in sets.columns if c != "cls"))
    return blocks.repartition("top", "x", "y").sortWithinPartitions("top", "x", "y", "side", "cls")


def _met_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, tuple]]:
    """(top, outer members, inner members) of every two parts of a block: each (cls, comp, n, batch)."""
    block: tuple | None = None
    held: list[tuple] = []
    for whole in batches:
        for at in range(0, whole.num_rows, INSIDE):
            batch = whole.slice(at, INSIDE)
            *names, cls, comp, n = (batch.column(i).to_numpy() for i in range(7))
            edges = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                here, part = tuple(int(c[lo]) for c in names[:3]), (cls[lo:hi], comp[lo:hi], n[lo:hi], batch.slice(lo, hi - lo))
                if here != block:
                    block, held = here, []
                if names[3][lo] == 0:
                    held.append(part)
                else:
                    yield from ((here[0], own, part) for own in held)


def _possible(top: int, own: tuple, part: tuple, prune: Prune, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of an outer and an inner member that sizes and sketches leave possible; pairs of two outer members once."""
    cls, comp, n, batch = own
    small, large = np.minimum(n[:, None], part[2]), np.maximum(n[:, None], part[2])
    i, j = np.nonzero((comp[:, None] != part[1]) & ((part[1] == top) | (cls[:, None] < part[0])) & (100 * small >= threshold * large))
    live = prune(_sketches(batch.column(7)), _sketches(part[3].column(7)), i, j, n, part[2])
    return i[live], j[live]


def living(member: DataFrame, sketches: DataFrame, threshold: int, prune: Prune) -> DataFrame:
    """Families (top, cls, comp, n) of components that still meet in a bucket, of member (bucket, cls, comp): members with a possible partner only."""
    sizes = member.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("bucket", "top")
    family = member.join(materialize(mixed, "link-mixed"), "bucket").groupBy("top", "cls").agg(F.first("comp").alias("comp")).join(sketches.select("cls", "n"), "cls")
    family = materialize(family, "link-families")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, own, part in _met_blocks(batches):
            i, j = _possible(top, own, part, prune, threshold)
            if len(i):
                cls = np.unique(np.concatenate([own[0][i], part[0][j]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), top)), pa.array(cls)], names=["top", "cls"])

    live = _dealt(family, sketches.select("cls", "sig")).mapInArrow(rows, "top long, cls long").distinct()
    return materialize(family.join(materialize(live, "link-living"), ["top", "cls"], "left_semi"), "link-families")


def crossing(family: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: int, prune: Prune) -> DataFrame:
    """Links (a, b) between the components of each family (top, cls, comp, n); several for two components are not all told."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, own, part in _met_blocks(batches):
            i, j = _possible(top, own, part, prune, threshold)
            joined: set[tuple[int, int]] = set()
            found: list[tuple[int, int]] = []
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if (own[1][x], part[1][y]) in joined:
                    continue
                if linked(*(np.frombuffer(c[k].as_buffer(), dtype=np.uint64) for c, k in ((own[3].column(8), x), (part[3].column(8), y))), threshold):
                    joined.add((own[1][x], part[1][y]))
                    found.append((int(own[0][x]), int(part[0][y])))
            if found:
                a, b = zip(*map(sorted, found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held = family.select("cls").distinct().join(sketches.select("cls", "sig"), "cls").join(sets, "cls")
    return _dealt(family, materialize(held, "link-held")).mapInArrow(rows, "a long, b long")


def connect(multi: DataFrame, sketches: DataFrame, fetch: Fetch, threshold: int, prune: Prune, least: int = 1) -> DataFrame | None:
    """(node, component) of all classes that link with another, None if none does; multi: bucket, cls, members; sketches: cls, rep, n, sig.

    Full sets are fetched for classes only once a sketch leaves a partner possible.
    least: buckets that a class shares with its pivot at least, in the first round only.
    """
    centre = multi.groupBy("cls").agg(F.sum("members").alias("met"))
    pivots = materialize(multi.join(centre, "cls").groupBy("bucket").agg(F.max_by("cls", F.struct("met", "cls")).alias("pivot")), "link-pivots")
    links: DataFrame | None = None
    comp: DataFrame | None = None
    sets: DataFrame | None = None
    member = multi.select("bucket", "cls", F.col("cls").alias("comp"))

    def sets_with(wanted: DataFrame) -> DataFrame:
        """Sets of the wanted classes (cls) and of those fetched before."""
        nonlocal sets
        wanted = wanted if sets is None else wanted.join(sets.select("cls"), "cls", "left_anti")
        wanted = materialize(sketches.join(wanted, "cls", "left_semi").select("cls", "rep"), "link-wanted")
        fresh = materialize(fetch(wanted), "link-sets")
        sets = fresh if sets is None else sets.unionByName(fresh)
        return sets

    def merged(found: DataFrame) -> bool:
        nonlocal links, comp, member
        found = materialize(found, "link-links")
        if not found.limit(1).count():
            return False
        links = found if links is None else links.unionByName(found)
        comp = materialize(components(links), "link-components")
        named = multi.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
        member = named.select("bucket", "cls", F.coalesce("component", "cls").alias("comp"))
        return True

    tried: DataFrame | None = None
    for turn in range(CONTRACTIONS):
        if turn == 0:
            shared = multi.select("bucket", "cls").join(pivots, "bucket").where("cls != pivot").groupBy("cls", "pivot").count().where(F.col("count") >= least)
            best = shared.groupBy("cls").agg(F.max_by("pivot", F.struct("count", F.hash("pivot"))).alias("pivot"))
            pairs = best.select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
        else:
            # a member of each component in a bucket, by another order each turn, and the bucket's largest component's
            own = materialize(member.groupBy("bucket", "comp").agg(F.count("*").alias("size"), F.min_by("cls", F.xxhash64("cls", F.lit(turn))).alias("cls")), "link-parts")
            largest = own.groupBy("bucket").agg(F.max_by("cls", F.struct("size", "comp")).alias("pivot"), F.max_by("comp", F.struct("size", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
            pairs = own.join(materialize(largest, "link-largest"), "bucket").where("comp != top").select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        tried = pairs = materialize(pairs, "link-pairs")
        left = materialize(survivors(pairs, sketches, threshold, prune), "link-survivors")
        both = left.select(F.col("a").alias("cls")).union(left.select("b")).distinct()
        if not left.limit(1).count() or not merged(confirmed(left, sets_with(both), threshold)):
            if turn:
                break
    family = living(materialize(member, "link-members"), sketches, threshold, prune)
    if family.limit(1).count():
        merged(crossing(family, sketches, sets_with(family.select("cls").distinct()), threshold, prune))
    return comp


def resolved(rows: DataFrame, classes: DataFrame, comp: DataFrame | None, key: str) -> DataFrame:
    """key, n_shingles, component_id, kept for rows (k, n, cls), by the classes' least keys (cls, rep) and their components."""
    kind = rows.schema["k"].dataType.simpleString()
    least = classes.select("cls", "rep")
    if comp is not None:
        joined = materialize(least.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "link-named")
        first = materialize(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "link-least")
        least = joined.join(first, "component").select("cls", F.col("component_id").alias("rep"))
        least = materialize(least, "link-result")
    out = rows.select("k", "n", "cls").join(least, "cls", "left")
    own = F.coalesce("rep", "k").cast(kind)
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), (F.col("k").isNull() | (F.col("k") == own)).alias("kept"))

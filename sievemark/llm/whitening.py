"""Whitening of embedding columns by matrix-free block subspace iteration.

Entries become whole numbers, ``floor(1024 * c) + 100000``, so their sums are
exact and every centred entry ``x - S / n`` is one division of whole numbers.
The covariance is never built: each pass is one Spark job in which tasks
multiply their centred rows with a block Q of a few directions, ``Xᵀ(XQ)``, and
rows of the product are summed by a shuffle. Between passes the driver holds
blocks of ``dimensions x BASIS`` numbers only, whatever the number of vectors:

* QR: the new block is made orthogonal to the directions that are kept.
* Rayleigh-Ritz: the best combinations of all kept directions, with their
  residuals ``V q - e q``. The next block holds residuals, those of the leading
  components first, and then directions drawn by a fixed seed. Directions stay from pass to pass
  until ``BASIS`` blocks are held; then the leading ones are kept. Spectra of
  embeddings are flat, and powers of V alone, without what is kept, would take
  thousands of passes.
* It ends when a pass over the components themselves leaves residuals below
  ``TOLERANCE`` of the largest eigenvalue: that certifies all of them.

Defined cases: rows whose vector is null or holds nulls, NaNs or infinities are
left out, and so are rows whose length isn't the commonest one (ties: the
longest). Null and repeated keys are kept, each row with its result. Fewer
components come out where there are fewer dimensions or where the rest of the
variance is zero within rounding; one vector, or equal vectors only, have none, and neither has an
empty table. Of equal eigenvalues any basis of their space is right. A
deviation that a long can't hold is null. Entries beyond ``LARGEST`` are an
error, as the whole numbers stop being exact there. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Directions that a pass multiplies, and blocks of them that are kept.
BLOCK, BASIS = 16, 8
TOLERANCE, PASSES = 1e-12, 400
#: Numbers that a task centres at a time.
HELD = 1 << 20
#: Bound of whole numbers: their doubles are exact, and so are products with as many rows as there are likely to be.
LARGEST = 1 << 40
#: Share of the largest eigenvalue that counts as none.
NONE = 1e-12


@dataclass
class Whitening:
    """What is fitted: n, exact sums by dimension (of the whole numbers less SHIFT), components as columns, eigenvalues, share of the variance, passes over the data, largest residual over the largest eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    passes: int
    residual: float


def whole(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """k, x (whole numbers less SHIFT) of the rows that count."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.where(sound).select(F.col(key).alias("k"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    entry = lambda c: F.when(F.abs(c) < LARGEST / SCALE, F.floor(SCALE * c)).otherwise(F.raise_error(F.lit(f"an entry lies beyond {LARGEST // SCALE}")).cast("long"))
    return materialize(rows.where(F.size("v") == d).select("k", F.transform("v", entry).alias("x")), "whitening")


def _blocks(column: pa.Array, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole numbers of some rows)."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    step = max(1, HELD // max(d, 1))
    for at in range(0, len(column), step):
        yield at, values[at : at + step]


def _exact(x: np.ndarray, squares: bool) -> np.ndarray:
    """Sums by column, as Python's whole numbers where longs could run over."""
    most = int(np.abs(x).max(initial=0)) ** (2 if squares else 1)
    own = x if most * max(len(x), 1) < 1 << 62 else x.astype(object)
    return (own * own if squares else own).sum(axis=0)


def moments(rows: DataFrame) -> tuple[int, list[int], list[int]]:
    """n, and by dimension the exact sums and sums of squares."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                d = len(batch.column(0)[0])
                for _, x in _blocks(batch.column(0), d):
                    n, s, q = n + len(x), s + _exact(x, False).astype(object), q + _exact(x, True).astype(object)
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array([n] * len(s), pa.int64()), *(pa.array([Decimal(int(v)) for v in c], kind) for c in (s, q))], names=["i", "n", "s", "q"])

    got = rows.select("x").mapInArrow(parts, "i int, n long, s decimal(38,0), q decimal(38,0)").groupBy("i").agg(*(F.sum(c).alias(c) for c in "nsq")).orderBy("i").collect()
    return (got[0]["n"] if got else 0), [int(r["s"]) for r in got], [int(r["q"]) for r in got]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def product(rows: DataFrame, n: int, sums: np.ndarray, q: np.ndarray) -> np.ndarray:
    """V q: one pass; each task sends a row for each dimension."""
    d, width = q.shape

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, width))
        for batch in batches:
            for _, x in _blocks(batch.column(0), d):
                c = _centred(x, n, sums)
                total += c.T @ (c @ q)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *(pa.array(total[:, j]) for j in range(width))], names=["i", *(f"y{j}" for j in range(width))])

    names = [f"y{j}" for j in range(width)]
    out = rows.select("x").mapInArrow(parts, "i int, " + ", ".join(f"{c} double" for c in names))
    got = out.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).orderBy("i").toArrow()
    return np.column_stack([got.column(c).to_numpy() for c in names]) / n


def _added(kept: np.ndarray, block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to kept."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        block = block - kept @ (kept.T @ block)
        block, r = np.linalg.qr(block)
        block = block[:, np.abs(np.diag(r)) > 1e-10]
    return block


def fit(rows: DataFrame, k: int = COMPONENTS, block: int = BLOCK) -> Whitening:
    """Leading components of rows (x): the subspace grows by a block a pass until the residuals certify them."""
    n, s, squares = moments(rows)
    d, sums = len(s), np.array(s, dtype=np.int64)
    # n² times the trace, exactly
    trace = sum(n * b - a * a for a, b in zip(s, squares, strict=True)) / n / n if n else 0.0
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0, 0.0)
    if trace <= 0:
        return none
    k, block = min(k, d), min(max(block, 2 * k), d)
    random = np.random.default_rng(11)
    q = np.linalg.qr(random.standard_normal((d, block)))[0]
    kept, image = np.zeros((d, 0)), np.zeros((d, 0))
    for passes in range(1, PASSES + 1):
        kept, image = np.hstack([kept, q]), np.hstack([image, product(rows, n, sums, q)])
        h = kept.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn[:, order]
        if kept.shape[1] + block > max(BASIS * block, 2 * block):
            turn = turn[:, : 2 * block]
        kept, image = kept @ turn, image @ turn
        residual = image - kept * values[: kept.shape[1]]
        size = np.linalg.norm(residual, axis=0)
        if kept.shape[1] >= d or size[:k].max() <= TOLERANCE * values[0]:
            found, _ = np.linalg.qr(kept[:, :k])
            certain = product(rows, n, sums, found)
            passes += 1
            inner, turn = np.linalg.eigh(found.T @ certain)
            found, certain, inner = found @ turn[:, ::-1], certain @ turn[:, ::-1], inner[::-1]
            left = float(np.linalg.norm(certain - found * inner, axis=0).max() / inner[0])
            if left <= TOLERANCE:
                real = inner > NONE * inner[0]
                return Whitening(n, sums, found[:, real], inner[real], inner[real] / trace, passes, left)
            if kept.shape[1] >= d:  # all that rounding leaves: start the space anew from the components
                kept, image, residual, size = found, certain, certain - found * inner, np.linalg.norm(certain - found * inner, axis=0)
        lead = residual[:, :block][:, size[:block] > 0]
        q = _added(kept, np.hstack([lead, random.standard_normal((d, block))]))[:, : min(block, d - kept.shape[1])]
    raise RuntimeError(f"the residuals of {k} components weren't certified in {PASSES} passes")


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    apart = n * x - sums
    most = int(np.abs(apart).max(initial=0))
    if most * most * max(x.shape[1], 1) < 1 << 63:
        return (apart * apart).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (apart.astype(object) ** 2).sum(axis=1).tolist()]


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened columns' covariance less the identity, in one pass."""
    d, k = model.components.shape
    n, sums, scaled = model.n, model.sums, model.components / np.sqrt(model.eigenvalues)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _blocks(batch.column(0), d):
                w = _centred(x, n, sums) @ scaled
                first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], names=["i", "v"])

    got = rows.select("x").mapInArrow(parts, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow().column("v").to_numpy() / n
    mean, second = got[:k], got[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """A row for each row of rows (k, x) and component."""
    kind = rows.schema["k"].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d, k = model.components.shape
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, scaled, explained, error = model.n, model.sums, model.components / np.sqrt(model.eigenvalues), model.explained, identity_error(rows, model)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch.column(1), d):
                w = _centred(x, n, sums) @ scaled
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)), pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(each)),
                     pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("k", "x").mapInArrow(parts, schema)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each sound vector and component."""
    rows = whole(vectors, key, vector)
    return transform(rows, fit(rows, k), key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))

"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never made: a pass over the rows computes Xᵀ(XQ) of the centred rows for a
block Q of directions, summed in each task and then by cell. QR of the product is the next
block, and Rayleigh-Ritz within the block gives components and their residuals, until those
certify all that are asked for. A block that comes on slowly is widened by new directions; one
as wide as the vectors is done in one pass.

Entries become whole numbers, so sums and deviations are exact. A vector that is null, has a
null or non-finite entry, or another length than most (of equally many, the longest) is left
out. Repeated rows, and rows without an id, count each. In a direction without variance there
is no whitened value: it is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components asked for, and the largest norm of a component's residual, as a share of the largest eigenvalue.
COMPONENTS, RESIDUAL = 8, 1e-13
#: First width of a block; a block that would take more than PATIENCE further passes is doubled.
WIDTH, PATIENCE = 16, 4
#: Whole numbers are held within this, far beyond any embedding, so that sums cannot overflow.
LARGEST = 1 << 40
#: Entries that a task works on at once.
AT_ONCE = 1 << 20


class Fit(NamedTuple):
    """Of ``n`` vectors: sums by dimension, components (a row each) with falling eigenvalues, the covariance's trace, the components' residuals, and the passes it took."""

    n: int
    total: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def _finite(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a batch's vectors have ``size`` entries, all finite numbers, and these as whole numbers, a row each."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == size)
    flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), size)
    fine = np.isfinite(flat).all(axis=1)  # a null entry is NaN here
    steps = np.clip(np.floor(SCALE * flat[fine]), -LARGEST, LARGEST)
    return fits[fine], steps.astype(np.int64) + OFFSET


def _matrices(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of vectors that count, and their matrix, of so few rows that a task's memory is bounded."""
    step = max(1, AT_ONCE // max(size, 1))
    for batch in batches:
        for first in range(0, len(batch), step):
            part = batch.slice(first, step)
            kept, x = _finite(part.column(at), size)
            if len(kept):
                yield part.take(pa.array(kept)), x


def _cells(rows: DataFrame, column: str, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``of`` a matrix of rows, as one flat array; as many numbers reach the driver as it has cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, x in _matrices(batches, 0, size):
            held = of(x) if held is None else held + of(x)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size, dtype=np.int32)), pa.array(held.ravel())], names=["cell", "value"])

    sums = rows.select(F.col(column).alias("v")).mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    return np.array([r.value for r in sums.orderBy("cell").collect()])


def totals(rows: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray]:
    """How many vectors count, and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for size in set(batch.column(0).value_lengths().drop_null().to_pylist()) - {0}:
                for _, x in _matrices(iter([batch]), 0, size):
                    n, sums = held.get(size, (0, 0))
                    held[size] = n + len(x), sums + x.sum(axis=0)
        for size, (n, sums) in held.items():
            cells = np.r_[sums, n]
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(cells), pa.int32()), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["size", "cell", "value"])

    cells = rows.select(F.col(column).alias("v")).mapInArrow(run, "size int, cell int, value long").groupBy("size", "cell").agg(F.sum("value").alias("value"))
    most = cells.where("cell = size").orderBy(F.desc("value"), F.desc("size")).first()
    if most is None:
        return 0, np.zeros(0, np.int64)
    sums = cells.where((F.col("size") == most["size"]) & (F.col("cell") < F.col("size"))).orderBy("cell").collect()
    return most["value"], np.array([r.value for r in sums], np.int64)


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, width: int = WIDTH, residual: float = RESIDUAL, seed: int = 0) -> Fit:
    """Components of the covariance of all vectors, each certified by its residual; as many as there are dimensions at most."""
    n, total = totals(rows, column)
    size = len(total)
    k, rng = min(components, size), np.random.default_rng(seed)
    if not n:
        return Fit(0, total, np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    mean = total / n
    block, worst, passes = np.linalg.qr(rng.standard_normal((size, min(width, size))))[0], None, 0
    while True:

        def product(x: np.ndarray, block: np.ndarray = block) -> np.ndarray:
            centred = x - mean
            return np.r_[(centred.T @ (centred @ block)).ravel(), (centred**2).sum()]

        cells = _cells(rows, column, size, product) / n
        made, trace, passes = cells[:-1].reshape(block.shape), float(cells[-1]), passes + 1
        inner = block.T @ made
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = block @ turn
        left = np.linalg.norm(made @ turn - vectors * values, axis=0)[:k]
        if block.shape[1] == size or left.max() <= residual * max(values[0], 0):
            return Fit(n, total, vectors[:, :k].T, np.maximum(values[:k], 0), trace, left, passes)
        slow = worst is not None and (left.max() >= worst or np.log(residual * values[0] / left.max()) / np.log(left.max() / worst) > PATIENCE)
        worst = None if slow else left.max()
        if slow:
            made = np.c_[made, rng.standard_normal((size, min(2 * made.shape[1], size) - made.shape[1]))]
        block = np.linalg.qr(made)[0]


def _scaled(found: Fit) -> np.ndarray:
    """Components over the roots of their eigenvalues; NaN where there is no variance."""
    least = len(found.total) * np.finfo(float).eps * max(found.values, default=0.0)
    root = np.sqrt(np.where(found.values > least, found.values, np.nan))
    return (found.vectors / root[:, None]).T


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sums over dimensions of ``(n * x - total) ** 2``, exact; None for one that no long holds."""
    off = n * x - total
    if (off.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
        return (off**2).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in off.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def transform(rows: DataFrame, found: Fit, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(id, deviation, whitened)`` of every vector that counts; ``whitened`` has a value a component."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(column).alias("v"))
    scaled, mean = _scaled(found), found.total / max(found.n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, x in _matrices(batches, 1, len(mean)):
            white = (x - mean) @ scaled
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(deviations(x, found.n, found.total), pa.int64()), cells], names=["id", "deviation", "whitened"])

    of = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, of)


def identity_error(rows: DataFrame, found: Fit, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over components with variance."""
    scaled, mean, size = _scaled(found), found.total / max(found.n, 1), len(found.total)
    scaled = scaled[:, np.isfinite(scaled).all(axis=0)]
    if not scaled.size:
        return 0.0
    middle = _cells(rows, column, size, lambda x: ((x - mean) @ scaled).sum(axis=0)) / found.n

    def products(x: np.ndarray) -> np.ndarray:
        centred = (x - mean) @ scaled - middle
        return centred.T @ centred

    k = scaled.shape[1]
    return float(np.abs(_cells(rows, column, size, products).reshape(k, k) / found.n - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that counts and each component, with the shares of variance and the error of the whole."""
    found = fit(rows, column, components)
    error = identity_error(rows, found, column) if found.n else 0.0
    shares = [float(v / found.trace) if found.trace else 0.0 for v in found.values]
    share = F.element_at(F.lit(shares).cast("array<double>"), F.col("component"))
    return (
        transform(rows, found, id_col, column)
        .select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened")
        .select("vec_id", "component", "n", "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
    )

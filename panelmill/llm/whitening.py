"""Operator 13: whitening of embeddings by a two-pass covariance.

Entries become integers, so sums are exact. The distinct vectors are written once, as the fit list; then

1. the first pass sums them exactly, in two halves of each integer: the mean is a ratio of integers;
2. the second pass centres each vector on it, multiplies blocks of rows by their transpose (GEMM) and adds the products up
   with ``treeAggregate``: d x d doubles a task, whatever the number of rows;
3. LAPACK's symmetric solver gives the components, the projection is broadcast (d x components doubles), and every row is
   projected where it stands. A third pass over the fit list measures how far the result is from white.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so are those whose
integers pass 53 bits and those of another length than the most frequent one (ties: the shorter); no row left gives no
rows; equal vectors count once in the fit and are all projected; a component without scatter (all vectors equal, or more
components than the vectors span) has null ``whitened`` and ``identity_error`` does not count it; ``explained`` is null where nothing
varies; a deviation beyond 64 bits is null; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, free_worker, own_name, stash

#: Rows that are multiplied at once.
BLOCK = 4096
_LOW = (1 << 26) - 1


class Fit(NamedTuple):
    """What a fit knows: n vectors with sums S = n * whole + rest, and the scaled components."""

    n: int
    whole: np.ndarray  # floor(S / n)
    rest: np.ndarray  # S mod n
    values: np.ndarray  # eigenvalues, falling
    projection: np.ndarray  # d x components, columns over sqrt(e); NaN: no scatter
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the integer part exactly, one rounding at the end."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n * x - S)^2 over dimensions, exactly."""
        y = x - self.whole
        most = int(np.abs(y).max(initial=0)) * self.n + self.n
        if most * most * x.shape[1] < 1 << 63:
            z = self.n * y - self.rest
            return pa.array(np.einsum("ij,ij->i", z, z), pa.int64())
        z = y.astype(object) * self.n - self.rest.astype(object)
        return pa.array([v if v < 1 << 63 else None for v in (z * z).sum(axis=1)], pa.int64())


def integers(df: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """``df`` with the column _x, floor(scale * entry) as longs; only rows that have one."""
    entries = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale))
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < float(1 << 53)))
    return df.withColumn("_x", F.when(F.coalesce(finite, F.lit(False)) & (F.size(vector_col) > 0), entries)).where("_x is not null")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    free_worker()
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            yield batch, np.asarray(batch.column("_x").flatten()).reshape(batch.num_rows, -1)


def _tree_sum(df: DataFrame, make: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> tuple | None:
    """Sums over all blocks of what ``make`` gives for one, merged in a tree; None without rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            part = make(x)
            total = part if total is None else tuple(a + b for a, b in zip(total, part))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[a.tobytes() for a in total]], pa.list_(pa.binary()))], ["_parts"])

    kinds = [(a.dtype, a.shape) for a in make(np.zeros((1, df.selectExpr("size(_x)").first()[0]), np.int64))]

    def read(row) -> tuple:
        return tuple(np.frombuffer(b, kind).reshape(shape) for b, (kind, shape) in zip(row._parts, kinds))

    def merge(a, b):
        return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b))

    return df.mapInArrow(run, "_parts array<binary>").rdd.treeAggregate(None, lambda total, row: merge(total, read(row)), merge, 3)


def fit(listed: DataFrame, components: int) -> Fit:
    """The components of a written table of distinct vectors _x, all of one length, at least one."""
    n, high, low = _tree_sum(listed, lambda x: (np.array(len(x), np.int64), (x >> 26).sum(axis=0), (x & _LOW).sum(axis=0)))
    n = int(n)
    sums = [(int(h) << 26) + int(v) for h, v in zip(high, low)]
    whole, rest = (np.array([divmod(s, n)[i] for s in sums], np.int64) for i in (0, 1))
    centre = Fit(n, whole, rest, *[np.zeros(0)] * 3)

    def product(x: np.ndarray) -> tuple[np.ndarray]:
        y = centre.centred(x)
        return (y.T @ y,)

    (total,) = _tree_sum(listed, product)
    values, vectors = np.linalg.eigh(total / n)
    values, vectors = values[::-1], vectors[:, ::-1][:, :components]
    trace = float(np.trace(total / n))
    scatter = values[: vectors.shape[1]] > max(values[0], 0) * len(values) * np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        projection = np.where(scatter, vectors / np.sqrt(np.where(scatter, values[: vectors.shape[1]], 1)), np.nan)
        explained = np.maximum(values[: vectors.shape[1]], 0) / trace if trace > 0 else np.full(vectors.shape[1], np.nan)
    return centre._replace(values=values, projection=projection, explained=explained)


def identity_error(listed: DataFrame, fitted: Fit) -> float | None:
    """The largest entry, without its sign, of the covariance of the whitened fit list minus the identity."""
    use = fitted.projection[:, ~np.isnan(fitted.projection).any(axis=0)]
    if not use.shape[1]:
        return None

    def product(x: np.ndarray) -> tuple[np.ndarray]:
        w = fitted.centred(x) @ use
        return (w.T @ w,)

    (total,) = _tree_sum(listed, product)
    return float(np.abs(total / fitted.n - np.eye(use.shape[1])).max())


def whiten(df: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    own_name(id_col, "component", "n", "deviation", "whitened", "explained", "identity_error")
    rows = integers(df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")), "_v", scale).select("_id", "_x")
    listed = stash(rows.select("_x").distinct(), "fit_list")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("_x").alias("_d")).count().orderBy(F.desc("count"), "_d").first()
    if lengths is None:
        return df.sparkSession.createDataFrame([], schema)
    of_length = F.size("_x") == lengths["_d"]
    listed_whole, listed = listed, listed.where(of_length)
    fitted = fit(listed, components)
    error = identity_error(listed, fitted)
    drop(listed_whole)
    sent = df.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        k = known.projection.shape[1]
        for batch, x in _blocks(batches):
            white = known.centred(x) @ known.projection
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [batch.column("_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, known.n)), known.deviations(x).take(each)]
            columns += [pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(known.explained, len(x)), from_pandas=True), pa.array([error] * (len(x) * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(of_length).mapInArrow(run, schema)

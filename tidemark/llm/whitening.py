"""Embedding whitening (operator 12): a covariance in two passes, its eigenvectors, a projection.

Components are quantised to whole numbers x = floor(1024 c) + 100000, so the first pass sums them exactly and the mean S/n
has no rounding of its own. The second pass centres every row on it (n x - S is a whole number, exact again) and sums outer
products by one matrix product a batch; each partition keeps one matrix, and treeAggregate merges them on executors. The
driver gets one d x d matrix, bounded by MAX_DIMENSION, and LAPACK's symmetric solver decomposes it; mean and eigenvectors
go to the tasks as a broadcast of d (k + 1) numbers, which the rows don't enlarge. identity_error measures the result: a
third pass over whitened rows, centred and merged alike.

Rows: those whose vector is null, empty, or holds null, non-finite or huge entries (2^30 or more) are left out, and so are
vectors of another length than the one most rows have (of equal shares the longer one), for which the components would mean
nothing. Repeated rows count each time. Directions without variance can't be whitened and give no component: a single row,
or rows all alike, have none. An empty table fits an empty model and gives an empty table. Other columns pass through; of the
new names, those that the table has are led by an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, fresh

SCALE, SHIFT, HUGE, MAX_DIMENSION, COMPONENTS = 1024, 100_000, 1 << 30, 8192, 8
RESULT = T.StructType([T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


@dataclass
class Whitening:
    """Rows fitted, exact sums by dimension, eigenvalues falling, unit eigenvectors as columns, and the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def usable(column: Column, dimension: int | None = None) -> Column:
    """True where a vector holds finite entries of moderate size only (and so many of them)."""
    fine = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < HUGE))
    size = F.size(column) > 0 if dimension is None else F.size(column) == dimension
    return F.coalesce(size & fine, F.lit(False))


def _quantised(vectors: pa.Array, d: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d) + SHIFT


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in 64 bits where they hold it, else in whole numbers of any size."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums.tolist()), default=0) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _sums(d: int):
    """A partition's exact sums by dimension; halves of 32 bits keep them in range for any number of rows."""

    def fold(batches):
        low, high = np.zeros(d, object), np.zeros(d, object)
        for b in batches:
            x = _quantised(b.column(0), d)
            low, high = low + (x & 0xFFFFFFFF).sum(axis=0), high + (x >> 32).sum(axis=0)
        total = [str(int(a) + (int(b) << 32)) for a, b in zip(low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total)], ["dimension", "total"])

    return fold


def merged(a, b):
    """Two partial moments (count, mean, sum of centred outer products) as one."""
    if a is None or b is None:
        return a if b is None else b
    (n, p, m), (k, q, r) = a, b
    step = q - p
    return n + k, p + step * (k / (n + k)), m + r + np.outer(step, step) * (n * k / (n + k))


def _moments(project):
    """Partial moments of projected rows, one row a partition. Rows are centred before they are multiplied."""

    def fold(batches):
        held = None
        for b in batches:
            z = project(b.column(0))
            if len(z):
                mean = z.mean(axis=0)
                held = merged(held, (len(z), mean, (z - mean).T @ (z - mean)))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1].tobytes()], pa.binary()), pa.array([held[2].tobytes()], pa.binary())], ["n", "mean", "products"])

    return fold


def moments(vectors: DataFrame, project) -> tuple | None:
    """The moments of all rows: partial ones a partition, merged in a tree on executors."""
    rows = vectors.mapInArrow(_moments(project), "n long, mean binary, products binary").rdd

    def add(held, row):
        mean = np.frombuffer(row["mean"])
        return merged(held, (row["n"], mean, np.frombuffer(row["products"]).reshape(len(mean), len(mean))))

    return rows.treeAggregate(None, add, merged, depth=3)


def shape(df: DataFrame, vector: str = "embedding") -> tuple[int, int]:
    """(rows, dimension): the length that most usable vectors have, of equal shares the longer, and how many have it; zeros without any."""
    own = df.select(F.col(f"`{vector}`").alias("v"))
    top = own.where(usable(F.col("v"))).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (top["count"], top["d"]) if top else (0, 0)


def fit(df: DataFrame, vector: str = "embedding", components: int | None = COMPONENTS, tolerance: float = 1e-12) -> Whitening:
    """Learns from all usable rows; eigenvalues at or under tolerance times the largest count as none."""
    bounded_batches(df.sparkSession)
    n, d = shape(df, vector)
    if d > MAX_DIMENSION:
        raise ValueError(f"a covariance of {d} dimensions exceeds MAX_DIMENSION")
    if not d:
        return Whitening(0, np.zeros(0, object), np.zeros(0), np.zeros((0, 0)), 0.0)
    v = F.col(f"`{vector}`")
    rows = df.where(usable(v, d)).select(v.alias("v"))
    totals = rows.mapInArrow(_sums(d), "dimension int, total string").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = np.array([int(r["total"]) for r in sorted(totals, key=lambda r: r["dimension"])], object)
    _, _, products = moments(rows, lambda b: _centred(_quantised(b, d), n, sums).astype(np.float64) / n)
    cov = products / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > tolerance * max(values.max(), 0)][:components]
    values, vectors = values[order], vectors[:, order]
    if len(order):
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, sums, values, vectors, float(np.trace(cov)))


def _whitened(held: Whitening, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t = _centred(_quantised(vectors, len(held.sums)), held.n, held.sums)
    return t, (t.astype(np.float64) / held.n) @ held.vectors / np.sqrt(held.values)


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", names: tuple[str, str] = ("deviation", "whitened")) -> DataFrame:
    """The usable rows of df with the exact squared deviation (sum of (n x - S)^2) and the whitened components."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def whiten(vectors: pa.Array) -> pa.Array:
        t, z = _whitened(shared.value, vectors)
        if t.dtype == object or t.size and np.abs(t).max() >= (1 << 31) / np.sqrt(t.shape[1]):
            t = t.astype(object)
        squares = [int(s) for s in (t * t).sum(axis=1)]
        squares = pa.array([s if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
        ends = np.arange(0, z.size + 1, max(z.shape[1], 1), dtype=np.int32) if z.shape[1] else np.zeros(len(z) + 1, np.int32)
        return pa.StructArray.from_arrays([squares, pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))], ["deviation", "whitened"])

    bounded_batches(df.sparkSession)
    names = fresh(df.columns, *names)
    (tmp,) = fresh([*df.columns, *names], "found")
    v = F.col(f"`{vector}`")
    out = df.where(usable(v, len(model.sums)) & F.lit(model.n > 0)).withColumn(tmp, whiten(v))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"{tmp}.{a}").alias(b) for a, b in zip(RESULT.names, names)))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured over all usable rows; None without components."""
    if not len(model.values):
        return None
    v = F.col(f"`{vector}`")
    shared = df.sparkSession.sparkContext.broadcast(model)
    n, _, products = moments(df.where(usable(v, len(model.sums))).select(v.alias("v")), lambda b: _whitened(shared.value, b)[1])
    return float(np.abs(products / n - np.eye(len(products))).max())

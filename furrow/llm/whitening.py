"""Whitening of embeddings by a two-pass covariance.

Entries become integers x = floor(scale * c) + shift, so that sums are exact whatever the order of rows.
Each distinct x vector counts once; these vectors are written once, and three passes read them.
The first sums them exactly, which gives the mean S / n. The second sums outer products of centred
blocks by one matrix product a block; each task's d x d sums are merged by ``treeAggregate``, so
that no single task and not the driver takes a matrix from every task. LAPACK's symmetric ``eigh``
of the covariance runs on the driver, on d x d numbers. The third pass measures the whitened
vectors' covariance. The projection, d x 16 numbers, is broadcast, and all rows are projected in
one pass without a shuffle.

Rows go whose vector is null, holds null or non-finite entries, or entries beyond 2**62 / scale, whose x
is no long. So do rows of another length than most distinct vectors have (the longer one on ties), as
they have no place in one covariance. Repeated rows, and rows with equal or null ids, stay, each for
itself, but their vector counts once in the fit. Components whose eigenvalue is zero within rounding
(fewer distinct vectors than dimensions, constant dimensions) can't be scaled to unit variance and
are left out; if all are, or without any vector, the result is empty. A deviation beyond a long is
null. Equal eigenvalues come in LAPACK's order; a component's largest entry (the first on ties) is
positive. Only vec_id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

SCALE, SHIFT = 64, 1_000_000
#: Numbers that a task holds of a batch at once.
BLOCK = 1_000_000
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """n vectors of exact sums; the projection's columns are eigenvectors over the root of their eigenvalues."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray
    narrow: bool  # n * x - S fits in 64 bits
    identity_error: float = 0.0

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        s = np.array(self.sums, dtype=np.int64 if self.narrow else object)
        return (x if self.narrow else x.astype(object)) * self.n - s

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        if self.narrow:
            return self.numerators(x) / self.n
        return np.array([[int(v) / self.n for v in row] for row in self.numerators(x)], dtype=np.float64).reshape(x.shape)


def integers(rows: DataFrame, column: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``rows`` with finite vectors, the vector as longs x."""
    limit = float(1 << 62) / scale
    entry = lambda c: c.cast("double")
    good = F.forall(column, lambda c: F.coalesce(F.abs(entry(c)) < limit, F.lit(False)))  # NaN is above all numbers
    known = rows.where(F.col(column).isNotNull()).where(good)
    return known.withColumn("x", F.transform(column, lambda c: F.floor(F.when(F.abs(entry(c)) < limit, entry(c) * scale).otherwise(0.0)) + shift)).drop(column)


def blocks(batches, column: int, width: int):
    """(rows, their vectors as an array) of at most about BLOCK numbers."""
    step = max(1, BLOCK // max(width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, width)


def _sums(vectors: DataFrame, width: int) -> tuple[int, list[int], int, int]:
    """n, the exact sums, least and largest entry. Halves of 32 bits are summed apart, so nothing overflows."""

    def rows(batches):
        n, high, low, least, most = 0, np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64), (1 << 63) - 1, -(1 << 63)
        for part, x in blocks(batches, 0, width):
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
            least, most = min(least, int(x.min())), max(most, int(x.max()))
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(width), pa.int32()), "n": pa.array([n] * width), "high": pa.array(high), "low": pa.array(low), "least": pa.array([least] * width), "most": pa.array([most] * width)})

    own = vectors.mapInArrow(rows, "at int, n long, high long, low long, least long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = own.groupBy("at").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("at").collect()  # a row a dimension
    return found[0].n, [(int(r.high) << 32) + int(r.low) for r in found], min(r.least for r in found), max(r.most for r in found)


def _outer(vectors: DataFrame, fit, width: int, of, size: int) -> np.ndarray:
    """The sum over ``vectors`` of outer products of ``of(fit, x)``, which has ``size`` columns."""
    given = vectors.sparkSession.sparkContext.broadcast(fit)

    def rows(batches):
        total, any_ = np.zeros((size, size)), False
        for _, x in blocks(batches, 0, width):
            z = of(given.value, x)
            total += z.T @ z
            any_ = True
        if any_:
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    merged = vectors.mapInArrow(rows, "m binary").rdd.map(lambda r: np.frombuffer(bytes(r.m)).reshape(size, size))
    out = merged.treeAggregate(np.zeros((size, size)), lambda a, b: a + b, lambda a, b: a + b)
    given.unpersist()
    return out


def fitted(vectors: DataFrame, width: int, most: int = 16) -> Fit | None:
    """The fit of distinct vectors ``x``; None if no dimension varies."""
    n, sums, least, largest = _sums(vectors, width)
    narrow = n * (largest - least) < 1 << 62 and n * max(abs(largest), abs(least), 1) < 1 << 62
    fit = Fit(n, sums, np.zeros((width, 0)), np.zeros(0), narrow)
    v = _outer(vectors, fit, width, lambda f, x: f.centred(x), width) / n
    value, vector = np.linalg.eigh((v + v.T) / 2)
    value, vector = value[::-1], vector[:, ::-1]
    kept = min(most, int((value > max(value[0], 0) * width * np.finfo(float).eps).sum()))
    if not kept:
        return None
    value, vector = value[:kept], vector[:, :kept]
    top = vector[np.abs(vector).argmax(0), np.arange(kept)]
    fit.projection, fit.explained = vector * np.sign(top) / np.sqrt(value), value / np.trace(v)
    own = _outer(vectors, fit, width, lambda f, x: f.centred(x) @ f.projection, kept) / n
    fit.identity_error = float(np.abs(own - np.eye(kept)).max())
    return fit


def whiten(rows: DataFrame, column: str = "embedding", most: int = 16, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row of ``rows`` and component."""
    spark = rows.sparkSession
    with scratch(spark):
        every = integers(rows.select("vec_id", F.col(column).alias("_vector")), "_vector", scale, shift)
        vectors = stored(every.select("x").distinct(), "vectors")
        longest = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()  # lengths, by count
        width = longest.d if longest else 0
        fit = fitted(vectors.where(F.size("x") == width), width, most) if width else None
    if fit is None:
        return spark.createDataFrame([], OUT)
    given = spark.sparkContext.broadcast(fit)

    def project(batches):
        names = [c.split()[0] for c in OUT.split(", ")]
        f = given.value
        k = f.projection.shape[1]
        for part, x in blocks(batches, 1, width):
            white = f.centred(x) @ f.projection
            spread = f.numerators(x)
            small = f.narrow and int(np.abs(spread).max()) ** 2 * width < 1 << 63
            total = (spread**2).sum(1) if small else (spread.astype(object) ** 2).sum(1)
            deviation = pa.array(total) if small else pa.array([int(t) if t < 1 << 63 else None for t in total], pa.int64())
            at = np.repeat(np.arange(part.num_rows), k)
            columns = [part.column(0).take(pa.array(at)), np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows), np.full(len(at), f.n), deviation.take(pa.array(at)), white.reshape(-1), np.tile(f.explained, part.num_rows), np.full(len(at), f.identity_error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return every.where(F.size("x") == width).select("vec_id", "x").mapInArrow(project, OUT)

"""Ridge regression of every fold and penalty from sums by year.

Rows are read once: each task sums, by year, the products of all pairs of columns (the target and a 1
among them), as differences from a common origin. Year-forward folds train on prefixes of years, so their
sums are running sums over the years; the score of a test year follows from that year's own sums. What
remains is one small linear system a fold and penalty, whatever the number of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCORES = "fold int, test_year int, alpha double, n_train long, n_test long, rmse double, r2 double"


def year_moments(rows: DataFrame, columns: list[str], origin: list[float]) -> DataFrame:
    """year, i, j (i <= j), total: sums of products of (columns - origin), 1 as the last column; rows with nulls don't count."""
    d = len(columns) + 1

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            year = batch.column(0).to_numpy(zero_copy_only=False)
            z = np.stack([*(batch.column(k + 1).to_numpy(zero_copy_only=False) - origin[k] for k in range(d - 1)), np.ones(len(year))], axis=1)
            for y in np.unique(year):
                own = z[year == y]
                held[int(y)] = held.get(int(y), 0) + own.T @ own
        i, j = np.triu_indices(d)
        for y, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), y), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])], ["year", "i", "j", "total"])

    known = rows.select(F.col("year").cast("int"), *(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns))).dropna()
    return known.mapInArrow(sums, "year int, i int, j int, total double").groupBy("year", "i", "j").agg(F.sum("total").alias("total"))


def fold_moments(moments: DataFrame, folds: DataFrame) -> DataFrame:
    """fold, test_year, i, j, train (sum over the years before), test (of the year itself)."""
    before = W.partitionBy("i", "j").orderBy("year").rowsBetween(W.unboundedPreceding, -1)
    running = moments.withColumn("train", F.sum("total").over(before)).withColumnRenamed("total", "test")
    return running.join(F.broadcast(folds.select("fold", "test_year")), F.col("year") == F.col("test_year")).select("fold", "test_year", "i", "j", "train", "test")  # a row a fold


def ridge_path(rows: DataFrame, folds: DataFrame, features: list[str], alphas: list[float], target: str = "yield") -> DataFrame:
    """``SCORES``: each fold's ridge regression of ``target`` for each penalty, the intercept free, on its test year.

    R2 is null where the test year's targets are all equal; a fold without training rows has no row. Rows
    that lack the year, the target or a feature don't count."""
    columns = [*features, target]
    shift = rows.agg(*(F.coalesce(F.avg(F.col(f"`{c}`").cast("double")), F.lit(0.0)).alias(f"m{k}") for k, c in enumerate(columns))).first()
    sums = fold_moments(year_moments(rows, columns, list(shift)), folds).orderBy("fold", "i", "j").collect()  # d * d numbers a fold
    out, d = [], len(columns) + 1
    for fold, year in sorted({(r.fold, r.test_year) for r in sums}):
        train, test = np.zeros((d, d)), np.zeros((d, d))
        for r in sums:
            if r.fold == fold:
                train[r.i, r.j] = train[r.j, r.i] = r.train or 0.0
                test[r.i, r.j] = test[r.j, r.i] = r.test
        n, m = train[-1, -1], test[-1, -1]
        if n <= 0:
            continue
        f, y = slice(0, d - 2), d - 2
        mean = train[-1] / n
        gram, cross = train[f, f] - n * np.outer(mean[f], mean[f]), train[f, y] - n * mean[f] * mean[y]
        total = test[y, y] - test[y, -1] ** 2 / m
        for alpha in alphas:
            v = np.linalg.lstsq(gram + alpha * np.eye(d - 2), cross, rcond=None)[0]
            full = np.concatenate([-v, [1.0, v @ mean[f] - mean[y]]])  # the residual is this times a row
            sse = max(float(full @ test @ full), 0.0)
            out.append((int(fold), int(year), float(alpha), int(round(n)), int(round(m)), float(np.sqrt(sse / m)), float(1 - sse / total) if total > 1e-12 * max(test[y, y], 1e-300) else None))
    return rows.sparkSession.createDataFrame(out, SCORES)

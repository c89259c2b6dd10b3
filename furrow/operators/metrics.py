"""Regression errors of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.scalars import finite


def regression_metrics(rows: DataFrame, by: list[str] = [], truth: str = "yield_true", pred: str = "yield_pred") -> DataFrame:
    """rmse, mae, mape (percent, zero truths left out), r2 (null below two distinct truths), n.

    Rows with a truth or prediction that isn't finite don't count. One aggregation, with partial sums."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    e = y - p
    spread = F.count("*") * F.var_pop(y)
    r2 = F.when(F.min(y) < F.max(y), 1 - F.try_divide(F.sum(e * e), spread))
    return rows.where(finite(y) & finite(p)).groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (100 * F.avg(F.when(F.abs(y) > 1e-12, F.abs(e / y)))).alias("mape"),
        r2.alias("r2"),
        F.count("*").alias("n"),
    )

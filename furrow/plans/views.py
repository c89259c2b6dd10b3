"""Tables behind the report and the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics_summary(rows: dict[str, DataFrame]) -> DataFrame:
    """One row a model, columns of all."""
    named = [df.select(F.lit(name).alias("model"), "*") for name, df in rows.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def timings(spark, seconds: dict[str, float]) -> DataFrame:
    """stage, seconds, with the total last."""
    rows = [*seconds.items(), ("total", sum(seconds.values()))]
    return spark.createDataFrame(rows, "stage string, seconds double")


def model_row(summary: DataFrame, name: str) -> DataFrame:
    return summary.where(F.col("model") == name).limit(1)


def f1_comparison(summary: DataFrame) -> DataFrame:
    """Baseline against the best classifier: out of fold, else cross-validated."""
    base = summary.where("model = 'Baseline'").select(F.lit("baseline").alias("label"), F.col("baseline_clf_macro_f1").alias("f1_macro"))
    best = summary.where("model = 'BestClassifier'").select(F.lit("best").alias("label"), F.coalesce(*(c for c in ("oof_f1_macro", "cv_f1_macro") if c in summary.columns)).alias("f1_macro"))
    return base.union(best)


def rmse_comparison(summary: DataFrame) -> DataFrame:
    parts = (("Baseline", "baseline", F.col("baseline_reg_rmse")), ("BestRegressor", "out of fold", F.coalesce(*(c for c in ("oof_rmse", "train_rmse") if c in summary.columns))), ("Backtest", "backtest", F.col("rmse")))
    return reduce(DataFrame.union, (summary.where(F.col("model") == m).select(F.lit(label).alias("label"), c.alias("rmse")) for m, label, c in parts))


def scenario_lines(scenarios: DataFrame, region: str, crop: str, names: list[str]) -> DataFrame:
    own = (F.col("region") == region) & (F.col("crop") == crop) & F.col("scenario").isin(*names)
    return scenarios.where(own).select("scenario", "year", "yield_pred").orderBy("scenario", "year")


def backtest_lines(backtest: DataFrame, region: str, crop: str) -> DataFrame:
    own = backtest.where((F.col("region") == region) & (F.col("crop") == crop))
    return own.unpivot(["year"], ["yield_true", "yield_pred"], "series", "value").orderBy("year", "series")


def top_importances(importance: DataFrame, k: int = 12) -> DataFrame:
    return importance.orderBy(F.desc("importance_mean"), "feature").limit(k)


def overview(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("n_rows"), F.count_distinct("region").alias("n_regions"), F.count_distinct("crop").alias("n_crops"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def sample_rows(panel: DataFrame, region: str, crop: str, n: int = 25) -> DataFrame:
    """Rows of a group, or of the whole panel if the group is empty."""
    ranked = panel.withColumn("_own", F.coalesce((F.col("region") == region) & (F.col("crop") == crop), F.lit(False)))
    any_own = ranked.agg(F.coalesce(F.bool_or("_own"), F.lit(False)).alias("_any"))
    return ranked.crossJoin(F.broadcast(any_own)).where("_own or not _any").drop("_own", "_any").orderBy("region", "crop", "year").limit(n)  # one row


def options(frame: DataFrame, column: str) -> DataFrame:
    return frame.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value")


def last_metrics(by_year: DataFrame, n: int = 5) -> DataFrame:
    return by_year.orderBy(F.desc("year")).limit(n).orderBy("year")

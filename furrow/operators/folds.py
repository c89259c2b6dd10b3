"""Year-forward folds: a small table of test years, joined to the panel by year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def year_folds(panel: DataFrame, n_splits: int = 4, min_train: int = 8, min_test: int = 4) -> DataFrame:
    """fold, test_year, train_before, n_train, n_test.

    The last ``n_splits`` years are tests if there are two more, else the last year alone; below
    three years there are none. Folds with few rows go; if all go, one fold of the last year stays
    whatever its size. Only counts by year are used: a row a year, however long the panel."""
    years = panel.where("year is not null").groupBy(F.col("year").cast("int").alias("year")).agg(F.count("*").alias("n"))
    by = W.orderBy("year")
    back = W.orderBy(F.desc("year"))
    every = W.partitionBy()
    counted = years.select(
        F.col("year").alias("test_year"),
        F.coalesce(F.sum("n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n_train"),
        F.col("n").alias("n_test"),
        F.row_number().over(back).alias("back"),
        F.count("*").over(every).alias("years"),
    ).where("years >= 3")
    tests = F.when(F.col("years") >= n_splits + 2, F.col("back") <= n_splits).otherwise(F.col("back") == 1)
    fit = tests & (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test)
    kept = counted.withColumn("fit", fit).withColumn("any", F.max(fit).over(every))
    kept = kept.where(F.col("fit") | (~F.col("any") & (F.col("back") == 1)))
    return kept.select((F.row_number().over(W.orderBy("test_year")) - 1).alias("fold"), "test_year", "n_train", "n_test")


def folded(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """The panel's rows once for each fold they train or test: fold, test_year, is_train.

    ``folds`` has a row a fold, n_splits at most, and is broadcast."""
    near = folds.select("fold", "test_year")
    return panel.join(F.broadcast(near), F.col("year") <= F.col("test_year")).withColumn("is_train", F.col("year") < F.col("test_year"))


def last_years(panel: DataFrame, n: int) -> DataFrame:
    """The last ``n`` distinct years, as test_year."""
    return panel.where("year is not null").select(F.col("year").cast("int").alias("test_year")).distinct().orderBy(F.desc("test_year")).limit(n)

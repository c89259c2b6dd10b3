"""The panel: one row per (region, crop, year), from star-schema tables or from stacked sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["region", "crop", "year"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, crop, year, yield, aod, pm from order lines.

    Lines shrink to one row an order before the join, so what is shuffled follows the orders.
    Sums are of whole hundredths, so the order of rows can't change them.
    The region and nation tables hold a fixed handful of rows and are broadcast."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *(F.sum(F.round(F.col(c) * 100).cast("long")).alias(s) for c, s in (("l_quantity", "q"), ("l_discount", "d"), ("l_tax", "t"))), F.count("*").alias("n")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "region", F.col("c_mktsegment").alias("crop"))
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(*KEY)
        .agg(*((F.sum(s) / 100.0 / F.sum("n")).alias(c) for s, c in (("q", "yield"), ("d", "aod"), ("t", "pm"))))
    )


def with_gaps(panel: DataFrame) -> DataFrame:
    """The panel with deterministic nulls, for operators about missing values."""
    return panel.withColumns({
        "pm": F.when(F.col("year") % 3 != 0, F.col("pm")),
        "aod": F.when((F.col("year") % 2 == 0) | (F.col("region") < "B"), F.col("aod")),
    })


def stack(sheets: list[DataFrame]) -> DataFrame:
    """Union of cleaned sheets; a column that a sheet lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def sheet_identity(name: F.Column) -> tuple[F.Column, F.Column]:
    """(region, crop) of ``REGION_CROP``; no second part: unknown; further parts are ignored."""
    parts = F.split(F.trim(name), "_")
    return F.trim(parts[0]), F.lower(F.trim(F.coalesce(F.get(parts, 1), F.lit("unknown"))))


def duplicate_keys(panel: DataFrame) -> DataFrame:
    """Keys that occur more than once; the panel's contract is that there are none."""
    return panel.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")

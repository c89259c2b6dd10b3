"""Dense numbers and running sums over a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.session import stored


def row_numbers(df: DataFrame, order: list, name: str, into: str = "row_number", weight: str | None = None, size: int | None = None) -> DataFrame:
    """Dense global numbers 0, 1, ... in the order of ``order`` (all rows, no single task).

    With ``weight`` the number is the running sum of that column before the row instead. The
    rows are range-partitioned and sorted once, written, and shifted by the totals of the
    partitions before theirs; only one total a partition is broadcast. ``size``: bytes of
    ``df``, if known. Equal keys all go to one partition: end ``order`` with a column that tells
    rows apart where many may be equal.
    """
    step = F.lit(1).cast("long") if weight is None else F.col(weight)
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    placed = stored(placed, name, size, keep=True)
    totals = placed.groupBy("_part").agg(F.sum(step).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_base"))
    if weight is None:
        within = F.col("_at").bitwiseAND((1 << 33) - 1)
    else:
        own = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        within = F.coalesce(F.sum(step).over(own), F.lit(0))
    return (
        placed.withColumn("_within", within)
        .join(F.broadcast(totals), "_part")  # one row a partition
        .withColumn(into, (F.col("_base") + F.col("_within")).cast("long"))
        .drop("_part", "_at", "_base", "_within")
    )

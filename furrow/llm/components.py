"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b", size: int | None = None) -> DataFrame:
    """node, component (smallest node reachable) for every node of an edge.

    Each round points every node at the smallest node near it: first all larger neighbours
    (large star), then itself and its smaller ones (small star), until edges stand still as stars around
    their smallest nodes. Nulls and loops are dropped. All state is in tables: a round is two
    aggregations with partial sums and two joins whose large keys Spark can split. ``size``: bytes
    of the edges, if known.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    pairs = stored(pairs, "edges", size)
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("lo"), F.col("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        pairs = stored(small.select("e.hi", "e.lo").where("hi > lo").distinct(), "edges", size)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, size = state, 32 * state[0]
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(pairs.select("lo", "lo").distinct())

"""Exact quantiles of groups of any size, by splitting ranges.

Each wanted rank starts with its group's whole range of values. While a range holds more than ``most`` rows
it is cut into ``parts``: rows are counted by part, which needs no row but its counter, and only the part that
holds the rank goes on, shrunk to the values in it. Ranges of one value are done, however many rows share
it. What is left is counted by distinct value. No task holds a group's values, and no rank needs more
than a few passes: each narrows its range by the factor ``parts``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.session import scratch, stored


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names), F.lit(True))


def _joined(rows: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` of (group, _v) with the ranges that hold them: _lo, _hi. A few ranges a group."""
    near = ranges.select(*(F.col(g).alias(f"_{i}") for i, g in enumerate(group)), "_lo", "_hi").distinct()
    on = reduce(lambda x, y: x & y, (rows[g].eqNullSafe(near[f"_{i}"]) for i, g in enumerate(group)), rows["_v"].between(near["_lo"], near["_hi"]))
    return rows.join(near, on).select(*group, "_v", "_lo", "_hi")


def exact_quantiles(rows: DataFrame, group: list[str], value: str, fractions: list[float], most: int = 100_000, parts: int = 1024) -> DataFrame:
    """group, n (known values), q (array of the fractions' quantiles, interpolated between neighbours), a row a group.

    Null values don't count; a group without any has n 0 and null quantiles. Null keys are a group. Equal to ``percentile``."""
    names = [f"_k{i}" for i in range(len(group))]
    keyed = [F.col(f"`{g}`").alias(k) for g, k in zip(group, names)]
    with scratch(rows.sparkSession):
        known = rows.where(F.col(value).isNotNull()).select(*keyed, F.col(value).cast("double").alias("_v"))
        sizes = stored(rows.groupBy(*keyed).agg(F.count(value).alias("n"), F.min(F.col(value).cast("double")).alias("_lo"), F.max(F.col(value).cast("double")).alias("_hi")), "sizes", keep=True)
        ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("_f"), ((F.col("n") - 1) * F.lit(float(p))).alias("_at")) for i, p in enumerate(fractions))))
        ends = F.explode(F.array(F.struct(F.lit(False).alias("_upper"), F.floor("_at").alias("_rank")), F.struct(F.lit(True).alias("_upper"), F.ceil("_at").alias("_rank"))))
        wanted = sizes.where("n > 0").select("*", ranks.alias("r")).select(*names, F.col("n").alias("_n"), "_lo", "_hi", "r.*").select(*names, "_n", "_lo", "_hi", "_f", "_at", ends.alias("e"))
        wanted = stored(wanted.select(*names, "_n", "_lo", "_hi", "_f", "_at", "e.*"), "wanted")
        open_ = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > most)
        while not wanted.where(open_).isEmpty():
            share = F.coalesce(F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2), F.lit(0.0))
            # the least value is a part of its own, so that every part is smaller than the range
            cut = F.when(F.col("_v") > F.col("_lo"), 1 + F.least(F.lit(parts - 1), F.floor(share * parts)).cast("int")).otherwise(0)
            counted = _joined(known, wanted.where(open_), names).groupBy(*names, "_lo", "_hi", cut.alias("_part")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
            before = W.partitionBy(*names, "_lo", "_hi").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
            placed = counted.withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0)))  # ``parts`` rows a range
            going, done = wanted.where(open_), wanted.where(~open_)
            inside = (going["_rank"] >= placed["_s"]) & (going["_rank"] < placed["_s"] + placed["_c"])
            nxt = going.join(placed, _same(going, placed, [*names, "_lo", "_hi"]) & inside)
            nxt = nxt.select(*(going[k] for k in names), F.col("_c").alias("_n"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_f", "_at", "_upper", (F.col("_rank") - F.col("_s")).alias("_rank"))
            wanted = stored(nxt.unionByName(done), "wanted")
        values = _joined(known, wanted.where("_lo < _hi"), names).groupBy(*names, "_lo", "_hi", "_v").agg(F.count("*").alias("_c"))
        upto = W.partitionBy(*names, "_lo", "_hi").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = values.withColumn("_s", F.sum("_c").over(upto))  # ``most`` rows a range
        going = wanted.where("_lo < _hi")
        inside = (going["_rank"] < placed["_s"]) & (going["_rank"] >= placed["_s"] - placed["_c"])
        found = going.join(placed, _same(going, placed, [*names, "_lo", "_hi"]) & inside).select(*(going[k] for k in names), "_f", "_at", "_upper", "_v")
        found = found.unionByName(wanted.where("_lo = _hi").select(*names, "_f", "_at", "_upper", F.col("_lo").alias("_v")))
        by = found.groupBy(*names, "_f", "_at").agg(F.max(F.when(~F.col("_upper"), F.col("_v"))).alias("_a"), F.max(F.when(F.col("_upper"), F.col("_v"))).alias("_b"))
        share = F.col("_at") - F.floor("_at")
        mixed = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b"))
        lists = by.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", mixed.alias("q")))), lambda x: x["q"]).alias("q"))  # a number a fraction
        lists = stored(lists, "quantiles", keep=True)
    out = sizes.join(lists, _same(sizes, lists, names), "left")
    return out.select(*(sizes[k].alias(g) for k, g in zip(names, group)), "n", "q")

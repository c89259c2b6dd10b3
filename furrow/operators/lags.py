"""Lags of the yield and statistics over lag columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.functions.scalars import finite

GROUP = ["region", "crop"]
WINDOWS = (2, 3, 5)
LAG_NAME = re.compile(r"^yield_lag_?(\d+)$")
EPS = 1e-8


def add_lags(panel: DataFrame, lags=(1, 2)) -> DataFrame:
    """yield_lag<k>: the k-th row before, by year, in the group. A missing year is no gap; rows
    whose region or crop is null get null."""
    by_year = W.partitionBy(*GROUP).orderBy("year")
    keyed = F.col("region").isNotNull() & F.col("crop").isNotNull()
    return panel.withColumns({f"yield_lag{k}": F.when(keyed, F.lag("yield", k).over(by_year)) for k in lags})


def lag_columns(names) -> list[tuple[int, str]]:
    """(k, column) sorted by k."""
    return sorted((int(m[1]), c) for c in names if (m := LAG_NAME.match(c)))


def lag_statistics(columns: list[tuple[int, str]]) -> dict[str, Column]:
    """Statistics per row over the lags, newest first; null values are left out.

    Statistics over w lags are null unless there are w lag columns. The slope runs over
    t = 1..w with t = 1 the newest, so it is positive where yields fell."""
    null = F.lit(None).cast("double")
    cols = [F.when(finite(F.col(c)), F.col(c)) for _, c in columns]
    of = {k: c for (k, _), c in zip(columns, cols)}
    count = lambda some: sum((c.isNotNull().cast("int") for c in some), F.lit(0))
    total = lambda some: sum((F.coalesce(c, F.lit(0.0)) for c in some), F.lit(0.0))
    out: dict[str, Column] = {
        "yield_lag_last": cols[0] if cols else null,
        "yield_lag_count_nonnull": count(cols[:5]).cast("double") if cols else null,
    }
    for w in WINDOWS:
        some = cols[:w]
        full = len(cols) >= w
        n = count(some)
        mean = F.when(n > 0, F.try_divide(total(some), n)) if full else null
        out[f"yield_lag_mean_{w}"] = mean
        if w == 2:
            continue
        if not full:
            out |= {f"yield_lag_{s}_{w}": null for s in ("std", "min", "max", "slope")}
            continue
        spread = total([(c - mean) * (c - mean) for c in some])
        out[f"yield_lag_std_{w}"] = F.when(n > 0, F.sqrt(F.try_divide(spread, n)))
        out[f"yield_lag_min_{w}"] = F.least(*some)
        out[f"yield_lag_max_{w}"] = F.greatest(*some)
        t = total([F.when(c.isNotNull(), F.lit(float(i + 1))) for i, c in enumerate(some)])
        tt = total([F.when(c.isNotNull(), F.lit(float((i + 1) ** 2))) for i, c in enumerate(some)])
        ty = total([c * float(i + 1) for i, c in enumerate(some)])
        base = n * tt - t * t
        out[f"yield_lag_slope_{w}"] = F.when((n >= 2) & (F.abs(base) > 1e-12), F.try_divide(n * ty - t * total(some), base))
    for k, j in ((1, 2), (2, 3), (4, 5)):
        out[f"yield_lag_momentum_{k}"] = of[1] - of[j] if 1 in of and j in of else null
    mean3 = out["yield_lag_mean_3"]
    out["yield_lag_ratio_last_mean3"] = F.try_divide(of[1], mean3 + EPS) if 1 in of and len(cols) >= 3 else null
    return out


def add_lag_statistics(frame: DataFrame) -> DataFrame:
    return frame.withColumns(lag_statistics(lag_columns(frame.columns)))


def add_interactions(frame: DataFrame) -> DataFrame:
    """Last lag against target means: three differences and two ratios; null where inputs lack."""
    have = lambda c: F.col(c) if c in frame.columns else F.lit(None).cast("double")
    last = have("yield_lag_last")
    crop, region, both = have("te_crop"), have("te_region"), have("te_region_crop")
    return frame.withColumns({
        "lag_last_minus_te_crop": last - crop,
        "lag_last_minus_te_region": last - region,
        "lag_last_minus_te_region_crop": last - both,
        "lag_last_div_te_crop": F.try_divide(last, crop + EPS),
        "lag_last_div_te_region_crop": F.try_divide(last, both + EPS),
    })


def last_yields(panel: DataFrame, k: int) -> DataFrame:
    """Per group the last k known yields by year, oldest first, padded in front with the oldest."""
    h = F.transform(F.array_sort(F.collect_list(F.struct("year", "yield"))), lambda x: x["yield"])
    got = panel.where("yield is not null").groupBy(*GROUP).agg(h.alias("h"))
    n = F.least(F.lit(k), F.size("h"))
    kept = F.slice("h", F.size("h") - n + 1, n)
    return got.select(*GROUP, F.concat(F.array_repeat(F.get(kept, 0), F.lit(k) - n), kept).alias("last_yields"))

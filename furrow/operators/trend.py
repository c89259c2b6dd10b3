"""Per-group trends of features, and features carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = ["region", "crop"]


def trend_terms(feature: str, name: str | None = None) -> dict[str, Column]:
    """Aggregates from which ``trend_at`` has the least-squares line of a feature over years."""
    name, f = name or feature, F.col(f"`{feature}`")
    seen = F.when(f.isNotNull(), F.col("year"))
    return {
        f"{name}__slope": F.regr_slope(f, F.col("year")),
        f"{name}__base": F.regr_intercept(f, F.col("year")),
        f"{name}__lo": F.min(f),
        f"{name}__hi": F.max(f),
        f"{name}__first": F.min_by(f, seen),
        f"{name}__n": F.count(f),
    }


def trend_at(name: str, year: Column) -> Column:
    """The line at ``year``; a single or constant value is itself; without any, null."""
    c = lambda s: F.col(f"`{name}__{s}`")
    return F.when(c("n") == 0, None).when((c("n") == 1) | (c("lo") == c("hi")), c("first")).otherwise(c("slope") * year + c("base"))


def trends(history: DataFrame, features: list[str], by: list[str] = GROUP) -> DataFrame:
    terms = {k: v for f in features for k, v in trend_terms(f).items()}
    return history.groupBy(*by).agg(*(v.alias(k) for k, v in terms.items()))


def trend_features(history: DataFrame, features: list[str], year: Column, by: list[str] = GROUP) -> DataFrame:
    """The keys and each feature by its trend at ``year``: a literal or one of ``by``."""
    return trends(history, features, by).select(*by, *(trend_at(f, year).alias(f) for f in features))


def carried(history: DataFrame, features: list[str], by: list[str] = GROUP) -> DataFrame:
    """Each feature's last known value by year; null if there is none."""
    last = lambda f: F.max_by(F.col(f"`{f}`"), F.when(F.col(f"`{f}`").isNotNull(), F.col("year"))).alias(f)
    return history.groupBy(*by).agg(*(last(f) for f in features))


def backtest_lags(panel: DataFrame, lags: list[int], tests: DataFrame) -> DataFrame:
    """region, crop, test_year, yield_lag<k>: the k-th last known yield before the test year, or
    the last one where there are fewer. The history of a group is one array, as long as its years."""
    h = F.transform(F.array_sort(F.collect_list(F.struct("year", "yield"))), lambda x: x["yield"])
    past = panel.where("yield is not null").join(F.broadcast(tests.select("test_year")), F.col("year") < F.col("test_year"))
    got = past.groupBy(*GROUP, "test_year").agg(h.alias("h"))
    at = lambda k: F.coalesce(F.try_element_at("h", F.lit(-k)), F.try_element_at("h", F.lit(-1)))
    return got.select(*GROUP, "test_year", *(at(k).alias(f"yield_lag{k}") for k in lags))

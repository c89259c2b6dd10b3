"""Backtests, recursive forecasts and scenarios.

The built-in model is a least-squares line of the yield on its first lag, whose closed form is a
SQL aggregate; any fitted model with ``transform`` can take its place in ``backtest_model``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.columns import resolved
from furrow.operators.folds import last_years
from furrow.operators.lags import add_lags, last_yields
from furrow.session import stored
from furrow.operators.trend import GROUP, backtest_lags, carried, trend_at, trend_features, trends


def backtest_linear(panel: DataFrame, years: int = 3) -> DataFrame:
    """region, crop, year, yield_lag1, yield_true, yield_pred: for each of the last years a line
    fitted to the rows before it. All years are fitted in one aggregation."""
    tests = F.broadcast(last_years(panel, years))
    rows = add_lags(panel, (1,)).where("yield is not null")
    fit = rows.where("yield_lag1 is not null").join(tests, F.col("year") < F.col("test_year")).groupBy("test_year").agg(
        F.regr_slope("yield", "yield_lag1").alias("slope"), F.regr_intercept("yield", "yield_lag1").alias("base")
    )
    history = backtest_lags(panel, [1], tests)
    truth = rows.select(*GROUP, F.col("year").alias("test_year"), F.col("yield").alias("yield_true"))
    out = truth.join(history, [*GROUP, "test_year"]).join(F.broadcast(fit), "test_year")  # a row a test year
    return out.select(*GROUP, F.col("test_year").alias("year"), "yield_lag1", "yield_true", (F.col("slope") * F.col("yield_lag1") + F.col("base")).alias("yield_pred"))


def backtest_features(panel: DataFrame, features: list[str], lags: list[int], years: int = 3) -> DataFrame:
    """Test rows with features by their trend before the test year and lags of the true history;
    groups without history, or without a true yield that year, have none."""
    tests = F.broadcast(last_years(panel, years))
    past = panel.join(tests, F.col("year") < F.col("test_year"))
    trend = trend_features(past, features, F.col("test_year"), [*GROUP, "test_year"])
    truth = panel.where("yield is not null").select(*GROUP, F.col("year").alias("test_year"), F.col("yield").alias("yield_true"))
    return truth.join(backtest_lags(panel, lags, tests), [*GROUP, "test_year"]).join(trend, [*GROUP, "test_year"]).withColumnRenamed("test_year", "year")


def backtest_model(panel: DataFrame, features: list[str], lags: list[int], fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], years: int = 3, least: int = 10) -> DataFrame:
    """Walk forward with any model: ``fit(train)`` returns a function that adds yield_pred."""
    rows, test = add_lags(panel, tuple(lags)), backtest_features(panel, features, lags, years)
    out = None
    for year in sorted(r.test_year for r in last_years(panel, years).collect()):  # a few years
        train = rows.where((F.col("year") < year) & F.col("yield").isNotNull())
        if train.limit(least).count() < least:
            continue
        one = fit(train)(test.where(F.col("year") == year))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no test year has enough training rows")
    return out


def line(panel: DataFrame) -> DataFrame:
    """One row, slope and base: the yield on its first lag over the whole panel."""
    rows = add_lags(panel, (1,)).where("yield is not null and yield_lag1 is not null")
    return rows.agg(F.regr_slope("yield", "yield_lag1").alias("slope"), F.regr_intercept("yield", "yield_lag1").alias("base"))


def future_years(panel: DataFrame, years: int) -> DataFrame:
    """Groups crossed with the years after the panel's last one (of all groups)."""
    last = panel.agg(F.max("year").alias("last"))
    groups = panel.where("region is not null and crop is not null").select(*GROUP).distinct()
    return groups.crossJoin(F.broadcast(last)).select(*GROUP, F.explode(F.sequence(F.col("last") + 1, F.col("last") + years)).alias("year"))  # one row


def recursive_forecast(panel: DataFrame, years: int = 10, features: list[str] = [], carry: bool = False) -> DataFrame:
    """region, crop, year, features, yield_lag1, yield_pred, forecast_method.

    Each prediction is the next year's lag. The recursion is one expression over a group's row,
    so it takes no join and no step per year. Features follow their trends, or with ``carry``
    keep their last known value; a short group starts from its own last yield."""
    seed = last_yields(panel, 1).select(*GROUP, F.get("last_yields", 0).alias("seed"))
    last = panel.agg(F.max("year").alias("last"))
    one = seed.crossJoin(F.broadcast(line(panel))).crossJoin(F.broadcast(last))  # one row each
    start = F.array(F.struct(F.lit(0).alias("k"), F.lit(None).cast("double").alias("lag"), F.col("seed").alias("pred")))
    grow = lambda acc, k: F.array_append(acc, F.struct(k.alias("k"), F.get(acc, k - 1)["pred"].alias("lag"), (F.col("slope") * F.get(acc, k - 1)["pred"] + F.col("base")).alias("pred")))
    steps = one.withColumn("s", F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, grow))).where("s.k > 0")
    out = steps.select(*GROUP, (F.col("last") + F.col("s.k")).cast("int").alias("year"), F.col("s.lag").alias("yield_lag1"), F.col("s.pred").alias("yield_pred"))
    if features and carry:
        out = out.join(carried(panel, features), GROUP, "left")
    elif features:
        out = out.join(trends(panel, features), GROUP, "left").select(*out.columns, *(trend_at(f, F.col("year")).alias(f) for f in features))
    return out.withColumn("forecast_method", F.lit("past_only" if carry else "trend_based"))


def recursive_model(panel: DataFrame, features: list[str], lags: int, predict: Callable[[DataFrame], DataFrame], years: int = 10, carry: bool = False) -> DataFrame:
    """The same with any fitted model: ``predict`` adds yield_pred to rows with features and
    yield_lag1..k. All groups of a year are predicted at once; the lags are one array a group.
    Each year's rows are written, so that neither the next year nor the result predicts them again."""
    last = panel.agg(F.max("year")).first()[0]
    base, out = last_yields(panel, lags), None
    if features:
        base = base.join(carried(panel, features) if carry else trends(panel, features), GROUP, "left")
    base = stored(base, "groups", keep=True)
    for year in range(last + 1, last + years + 1):
        values = [F.col(f"`{f}`") if carry else trend_at(f, F.lit(year)).alias(f) for f in features]
        rows = base.select(*GROUP, F.lit(year).alias("year"), *values, *(F.try_element_at("last_yields", F.lit(-k)).alias(f"yield_lag{k}") for k in range(1, lags + 1)))
        done = stored(predict(rows), "year", keep=True)
        out = done if out is None else out.unionByName(done)
        nxt = done.select(*GROUP, F.col("yield_pred").alias("_p"))
        state = base.select(*GROUP, "last_yields").join(nxt, GROUP).select(*GROUP, F.array_append(F.slice("last_yields", 2, lags), F.col("_p")).alias("last_yields"))
        base = stored(state.join(base.drop("last_yields"), GROUP), "groups", keep=True)
    return out


def trend_forecast(panel: DataFrame, feature: str = "yield", years: int = 10) -> DataFrame:
    """Without lags: the feature's own trend in each future year."""
    return future_years(panel, years).join(trends(panel, [feature]), GROUP).select(*GROUP, "year", trend_at(feature, F.col("year")).alias(f"{feature}_pred"))


SCENARIOS = {"baseline": 1.0, "clean_air": 0.8, "polluted": 1.2}


def scenarios(forecast: DataFrame, aod: list[str], pm: list[str], predict: Callable[[DataFrame], DataFrame] | Column | None = None, factors: dict[str, float] = SCENARIOS, legacy_double_scale: bool = False) -> DataFrame:
    """The forecast once for each scenario, its aerosol columns scaled and re-predicted.

    Lags stay those of the baseline: only the direct effect shows. A column that two names mean is
    scaled once; ``legacy_double_scale`` scales it once for each name."""
    columns = resolved(forecast.columns, [*aod, *pm])
    table = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("factor")) for n, f in factors.items()))
    wide = forecast.withColumn("_s", F.explode(table)).withColumn("scenario", F.col("_s.scenario"))
    times = {c: sum(resolved(forecast.columns, [n]) == [c] for n in [*aod, *pm]) if legacy_double_scale else 1 for c in columns}
    wide = wide.withColumns({c: F.col(f"`{c}`") * F.pow(F.col("_s.factor"), F.lit(float(times[c]))) for c in columns}).drop("_s")
    if predict is None:
        return wide
    if isinstance(predict, Column):
        return wide.withColumn("yield_pred", predict)
    return predict(wide.drop("yield_pred"))

"""The library's operators as queries over the driver's tables, with their SQL.

Numbers are rounded to six places on both sides: engines sum doubles in different orders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.functions.scalars import number
from furrow.learners.catalogue import REGRESSORS
from furrow.operators import columns, forecast, preprocess, search
from furrow.operators.classes import add_classes, add_target_means, baselines, class_metrics, class_weights, target_means, to_class
from furrow.operators.folds import folded, last_years, year_folds
from furrow.operators.lags import add_interactions, add_lag_statistics, add_lags, last_yields
from furrow.operators.metrics import regression_metrics
from furrow.operators.moments import ridge_path
from furrow.operators.quantiles import exact_quantiles
from furrow.operators.trend import carried, trend_features
from furrow.plans import views
from furrow.session import own_dir, stored
from furrow.sources import files
from furrow.sources.panel import panel_view, sheet_identity, stack, table, with_gaps
from furrow.sources.sheets import build_panel, canonical_text, header_rows, header_scores, merged_headers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PANEL = """panel AS (
  SELECT r_name AS region, c_mktsegment AS crop, CAST(year(o_orderdate) AS INT) AS year,
         sum(CAST(round(l_quantity * 100) AS BIGINT))::DOUBLE / 100.0::DOUBLE / count(*) AS yield,
         sum(CAST(round(l_discount * 100) AS BIGINT))::DOUBLE / 100.0::DOUBLE / count(*) AS aod,
         sum(CAST(round(l_tax * 100) AS BIGINT))::DOUBLE / 100.0::DOUBLE / count(*) AS pm
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name, c_mktsegment, year(o_orderdate))"""
GAPS = """gaps AS (
  SELECT region, crop, year, yield, CASE WHEN year % 2 = 0 OR region < 'B' THEN aod END AS aod,
         CASE WHEN year % 3 <> 0 THEN pm END AS pm FROM panel)"""
LAGS = """lagged AS (
  SELECT *, lag(yield, 1) OVER w AS lag1, lag(yield, 2) OVER w AS lag2 FROM panel
  WINDOW w AS (PARTITION BY region, crop ORDER BY year))"""
TESTS = "tests AS (SELECT DISTINCT year AS t FROM panel ORDER BY t DESC LIMIT 3)"
BACKTEST = f"""{PANEL}, {LAGS}, {TESTS},
fit AS (SELECT t, regr_slope(yield, lag1) AS b, regr_intercept(yield, lag1) AS a FROM lagged JOIN tests ON year < t WHERE lag1 IS NOT NULL GROUP BY t),
bt AS (SELECT region, crop, year, lag1 AS yield_lag1, yield AS yield_true, a + b * lag1 AS yield_pred FROM lagged JOIN fit ON year = t WHERE lag1 IS NOT NULL)"""
CLASSES = """q AS (SELECT crop, quantile_cont(yield, 1.0/3) AS q1, quantile_cont(yield, 2.0/3) AS q2 FROM panel GROUP BY crop),
classed AS (SELECT p.*, CASE WHEN yield < q1 THEN 0 WHEN yield < q2 THEN 1 ELSE 2 END AS yield_class FROM panel p JOIN q USING (crop))"""
ERRORS = """round(sqrt(avg((yield_true - yield_pred) ** 2)), 6) AS rmse, round(avg(abs(yield_true - yield_pred)), 6) AS mae,
round(100 * avg(CASE WHEN abs(yield_true) > 1e-12 THEN abs((yield_true - yield_pred) / yield_true) END), 6) AS mape,
round(1 - sum((yield_true - yield_pred) ** 2) / (count(*) * var_pop(yield_true)), 6) AS r2, count(*) AS n"""
RECURSION = f"""{PANEL}, {LAGS},
m AS (SELECT regr_slope(yield, lag1) AS b, regr_intercept(yield, lag1) AS a FROM lagged WHERE lag1 IS NOT NULL),
final AS (SELECT max(year) AS ly FROM panel),
seed AS (SELECT region, crop, max_by(yield, year) AS y FROM panel GROUP BY region, crop),
walk(region, crop, k, yield_lag1, yield_pred) AS (
  SELECT region, crop, 1, y, a + b * y FROM seed, m
  UNION ALL SELECT region, crop, k + 1, yield_pred, a + b * yield_pred FROM walk, m WHERE k < 10),
fc AS (SELECT region, crop, CAST(ly + k AS INT) AS year, yield_lag1, yield_pred FROM walk, final)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c, t in df.dtypes if t == "double"})


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"WITH {PANEL} SELECT region, crop, year, round(yield, 6) AS yield, round(aod, 6) AS aod, round(pm, 6) AS pm FROM panel")
def panel_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_view(spark, sf_dir)


@query(f"WITH {PANEL}, {LAGS} SELECT region, crop, year, round(yield, 6) AS yield, round(lag1, 6) AS yield_lag1, round(lag2, 6) AS yield_lag2 FROM lagged")
def lag_features(spark, sf_dir):
    return add_lags(panel_view(spark, sf_dir)).select("region", "crop", "year", "yield", "yield_lag1", "yield_lag2")


@query(f"WITH {PANEL}, {CLASSES} SELECT region, crop, year, yield_class FROM classed")
def yield_class(spark, sf_dir):
    return add_classes(panel_view(spark, sf_dir)).select("region", "crop", "year", "yield_class")


def _stats(w: int, *names: str) -> str:
    forms = {"mean": "avg(y)", "std": "stddev_pop(y)", "min": "min(y)", "max": "max(y)", "slope": "regr_slope(y, t)"}
    two = f"count(y) FILTER (WHERE t <= {w}) >= 2"  # a slope needs two points
    form = {n: f"{forms[n]} FILTER (WHERE t <= {w})" for n in names}
    return ", ".join(f"round({f'CASE WHEN {two} THEN {form[n]} END' if n == 'slope' else form[n]}, 6) AS yield_lag_{n}_{w}" for n in names)


@query(f"""WITH {PANEL}, five AS (SELECT region, crop, year, unnest([1, 2, 3, 4, 5]) AS t,
  unnest([lag(yield, 1) OVER w, lag(yield, 2) OVER w, lag(yield, 3) OVER w, lag(yield, 4) OVER w, lag(yield, 5) OVER w]) AS y
  FROM panel WINDOW w AS (PARTITION BY region, crop ORDER BY year))
SELECT region, crop, year, round(max(y) FILTER (WHERE t = 1), 6) AS yield_lag_last, CAST(count(y) AS DOUBLE) AS yield_lag_count_nonnull,
{_stats(2, "mean")}, {_stats(3, "mean", "std", "min", "max", "slope")}, {_stats(5, "mean", "std", "min", "max", "slope")},
round(max(y) FILTER (WHERE t = 1) - max(y) FILTER (WHERE t = 2), 6) AS yield_lag_momentum_1,
round(max(y) FILTER (WHERE t = 1) - max(y) FILTER (WHERE t = 3), 6) AS yield_lag_momentum_2,
round(max(y) FILTER (WHERE t = 1) - max(y) FILTER (WHERE t = 5), 6) AS yield_lag_momentum_4,
round(max(y) FILTER (WHERE t = 1) / (avg(y) FILTER (WHERE t <= 3) + 1e-8), 6) AS yield_lag_ratio_last_mean3
FROM five GROUP BY region, crop, year""")
def lag_stats(spark, sf_dir):
    full = add_lag_statistics(add_lags(panel_view(spark, sf_dir), (1, 2, 3, 4, 5)))
    return full.select("region", "crop", "year", *(c for c in full.columns if c.startswith("yield_lag_")))


@query(f"""WITH {PANEL}, y AS (SELECT year, count(*) AS n, row_number() OVER (ORDER BY year DESC) AS back FROM panel GROUP BY year),
f AS (SELECT year AS test_year, (SELECT sum(n) FROM y b WHERE b.year < a.year) AS n_train, n AS n_test FROM y a WHERE back <= CASE WHEN (SELECT count(*) FROM y) >= 6 THEN 4 ELSE 1 END)
SELECT CAST(row_number() OVER (ORDER BY test_year) - 1 AS INT) AS fold, test_year, CAST(n_train AS BIGINT) AS n_train, n_test FROM f WHERE n_train >= 8 AND n_test >= 4""")
def year_fold_table(spark, sf_dir):
    return year_folds(panel_view(spark, sf_dir))


@query(f"""WITH {PANEL}, f AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS fold FROM (SELECT DISTINCT year AS t FROM panel ORDER BY t DESC LIMIT 4))
SELECT CAST(fold AS INT) AS fold, region, crop, year, year < t AS is_train FROM panel JOIN f ON year <= t""")
def year_fold_rows(spark, sf_dir):
    panel = panel_view(spark, sf_dir)
    return folded(panel, year_folds(panel)).select("fold", "region", "crop", "year", "is_train")


TE = """tr AS (SELECT * FROM panel WHERE year < (SELECT max(year) FROM panel)), g AS (SELECT avg(yield) AS g FROM tr),
te AS (SELECT region, crop, year, yield,
  (SELECT (count(yield) * coalesce(avg(yield), 0) + 10 * any_value(g)) / (count(yield) + 10) FROM tr, g WHERE tr.crop = p.crop) AS te_crop,
  (SELECT (count(yield) * coalesce(avg(yield), 0) + 10 * any_value(g)) / (count(yield) + 10) FROM tr, g WHERE tr.region = p.region) AS te_region,
  (SELECT (count(yield) * coalesce(avg(yield), 0) + 10 * any_value(g)) / (count(yield) + 10) FROM tr, g WHERE tr.region = p.region AND tr.crop = p.crop) AS te_region_crop
  FROM panel p)"""


def _with_te(spark, sf_dir, lags=()):
    panel = panel_view(spark, sf_dir)
    last = panel.agg(F.max("year").alias("last"))
    train = panel.crossJoin(F.broadcast(last)).where("year < last").drop("last")  # one row
    return add_target_means(add_lags(panel, lags) if lags else panel, target_means(train))


@query(f"WITH {PANEL}, {TE} SELECT region, crop, year, round(te_crop, 6) AS te_crop, round(te_region, 6) AS te_region, round(te_region_crop, 6) AS te_region_crop FROM te")
def target_mean(spark, sf_dir):
    return _with_te(spark, sf_dir).select("region", "crop", "year", "te_crop", "te_region", "te_region_crop")


@query(f"""WITH {PANEL}, {TE}, l AS (SELECT *, lag(yield) OVER (PARTITION BY region, crop ORDER BY year) AS y FROM te)
SELECT region, crop, year, round(y - te_crop, 6) AS lag_last_minus_te_crop, round(y - te_region, 6) AS lag_last_minus_te_region,
round(y - te_region_crop, 6) AS lag_last_minus_te_region_crop, round(y / (te_crop + 1e-8), 6) AS lag_last_div_te_crop, round(y / (te_region_crop + 1e-8), 6) AS lag_last_div_te_region_crop FROM l""")
def lag_te_inter(spark, sf_dir):
    full = add_interactions(add_lag_statistics(_with_te(spark, sf_dir, (1,))))
    return full.select("region", "crop", "year", *search.INTERACTIONS)


@query(f"""WITH {PANEL}, {CLASSES}, c AS (SELECT yield_class, count(*) AS n FROM classed GROUP BY yield_class)
SELECT round((SELECT 2.0 * max(n) / (sum(n) + max(n)) / count(*) FROM c), 6) AS baseline_clf_macro_f1, round(stddev_pop(yield), 6) AS baseline_reg_rmse, 0.0::DOUBLE AS baseline_reg_r2 FROM panel""")
def baseline_metrics(spark, sf_dir):
    return baselines(add_classes(panel_view(spark, sf_dir)))


def _trend(c: str) -> str:
    return f"round(CASE WHEN count({c}) = 1 OR min({c}) = max({c}) THEN min_by({c}, year) FILTER (WHERE {c} IS NOT NULL) ELSE regr_slope({c}, year) * t + regr_intercept({c}, year) END, 6) AS {c}"


@query(f"WITH {PANEL}, {GAPS}, {TESTS} SELECT region, crop, t AS test_year, {_trend('aod')}, {_trend('pm')} FROM gaps JOIN tests ON year < t GROUP BY region, crop, t")
def trend_extrapolation(spark, sf_dir):
    panel = with_gaps(panel_view(spark, sf_dir))
    past = panel.join(F.broadcast(last_years(panel, 3)), F.col("year") < F.col("test_year"))  # three rows
    return trend_features(past, ["aod", "pm"], F.col("test_year"), ["region", "crop", "test_year"])


@query(f"WITH {PANEL}, {GAPS} SELECT region, crop, round(max_by(aod, year) FILTER (WHERE aod IS NOT NULL), 6) AS aod, round(max_by(pm, year) FILTER (WHERE pm IS NOT NULL), 6) AS pm FROM gaps GROUP BY region, crop")
def carry_forward(spark, sf_dir):
    return carried(with_gaps(panel_view(spark, sf_dir)), ["aod", "pm"])


@query(f"""WITH {PANEL}, h AS (SELECT region, crop, list(yield ORDER BY year) AS h FROM panel GROUP BY region, crop)
SELECT region, crop, round(coalesce(h[-3], h[1]), 6) AS y3, round(coalesce(h[-2], h[1]), 6) AS y2, round(h[-1], 6) AS y1 FROM h""")
def last_k_yields(spark, sf_dir):
    got = last_yields(panel_view(spark, sf_dir), 3)
    return got.select("region", "crop", *(F.get("last_yields", i).alias(f"y{3 - i}") for i in range(3)))


@query(f"WITH {BACKTEST} SELECT region, crop, year, round(yield_lag1, 6) AS yield_lag1, round(yield_true, 6) AS yield_true, round(yield_pred, 6) AS yield_pred FROM bt")
def backtest_linear(spark, sf_dir):
    return forecast.backtest_linear(panel_view(spark, sf_dir))


@query(f"WITH {BACKTEST} SELECT {ERRORS} FROM bt")
def backtest_metrics_overall(spark, sf_dir):
    return regression_metrics(forecast.backtest_linear(panel_view(spark, sf_dir)))


@query(f"WITH {BACKTEST} SELECT year, {ERRORS} FROM bt GROUP BY year")
def backtest_metrics_by_year(spark, sf_dir):
    return regression_metrics(forecast.backtest_linear(panel_view(spark, sf_dir)), ["year"])


def _wide_trend(c: str) -> str:
    return f"CASE WHEN count({c}) = 1 OR min({c}) = max({c}) THEN min({c}) ELSE regr_intercept({c}, year) END AS {c}_a, CASE WHEN count({c}) = 1 OR min({c}) = max({c}) THEN 0 ELSE regr_slope({c}, year) END AS {c}_b"


@query(f"""WITH RECURSIVE {RECURSION}, {GAPS}, tr AS (SELECT region, crop, {_wide_trend('aod')}, {_wide_trend('pm')} FROM gaps GROUP BY region, crop)
SELECT region, crop, year, round(yield_lag1, 6) AS yield_lag1, round(yield_pred, 6) AS yield_pred, round(aod_a + aod_b * year, 6) AS aod, round(pm_a + pm_b * year, 6) AS pm, 'trend_based' AS forecast_method FROM fc JOIN tr USING (region, crop)""")
def recursive_forecast(spark, sf_dir):
    return forecast.recursive_forecast(with_gaps(panel_view(spark, sf_dir)), 10, ["aod", "pm"])


PAST = f"""{RECURSION}, {GAPS}, cf AS (SELECT region, crop, max_by(aod, year) FILTER (WHERE aod IS NOT NULL) AS aod, max_by(pm, year) FILTER (WHERE pm IS NOT NULL) AS pm FROM gaps GROUP BY region, crop)"""


@query(f"WITH RECURSIVE {PAST} SELECT region, crop, year, round(yield_lag1, 6) AS yield_lag1, round(yield_pred, 6) AS yield_pred, round(aod, 6) AS aod, round(pm, 6) AS pm, 'past_only' AS forecast_method FROM fc JOIN cf USING (region, crop)")
def past_only_forecast(spark, sf_dir):
    return forecast.recursive_forecast(with_gaps(panel_view(spark, sf_dir)), 10, ["aod", "pm"], carry=True)


@query(f"""WITH RECURSIVE {PAST}, s(scenario, f) AS (VALUES ('baseline', 1.0), ('clean_air', 0.8), ('polluted', 1.2))
SELECT scenario, region, crop, year, round(aod * f, 6) AS aod, round(pm * f, 6) AS pm, round(yield_lag1, 6) AS yield_lag1, round(yield_lag1 - 10 * aod * f - 5 * pm * f, 6) AS yield_pred, 'past_only' AS forecast_method FROM fc JOIN cf USING (region, crop), s""")
def scenarios(spark, sf_dir):
    base = forecast.recursive_forecast(with_gaps(panel_view(spark, sf_dir)), 10, ["aod", "pm"], carry=True)
    return forecast.scenarios(base, ["AOD", "Aod"], ["pm"], F.col("yield_lag1") - 10 * F.col("aod") - 5 * F.col("pm"))


@query(f"WITH {PANEL} SELECT region, crop, CAST(unnest(range(2002, 2012)) AS INT) AS year, round(b * unnest(range(2002, 2012)) + a, 6) AS yield_pred FROM (SELECT region, crop, regr_slope(yield, year) AS b, regr_intercept(yield, year) AS a FROM panel GROUP BY region, crop)")
def trend_forecast(spark, sf_dir):
    return forecast.trend_forecast(panel_view(spark, sf_dir))


TERTILE = f"""{BACKTEST}, tr AS (SELECT * FROM panel WHERE year < (SELECT max(year) FROM panel)), crops AS (SELECT crop, quantile_cont(yield, 1.0/3) AS t1, quantile_cont(yield, 2.0/3) AS t2 FROM tr GROUP BY crop),
{CLASSES}, pc AS (SELECT region, crop, year, CASE WHEN yield_pred <= t1 THEN 0 WHEN yield_pred <= t2 THEN 1 ELSE 2 END AS pred_class FROM bt JOIN crops USING (crop)),
both_ AS (SELECT * FROM pc JOIN classed USING (region, crop, year))"""


def _tertiles(spark, sf_dir):
    panel = panel_view(spark, sf_dir)
    last = panel.agg(F.max("year").alias("last"))
    train = panel.crossJoin(F.broadcast(last)).where("year < last")  # one row
    return to_class(forecast.backtest_linear(panel), train).join(add_classes(panel).select("region", "crop", "year", "yield_class"), ["region", "crop", "year"])


@query(f"WITH {TERTILE} SELECT region, crop, year, pred_class, yield_class FROM both_")
def reg_to_tertile(spark, sf_dir):
    return _tertiles(spark, sf_dir).select("region", "crop", "year", "pred_class", "yield_class")


@query(f"""WITH {TERTILE}, labels_ AS (SELECT DISTINCT unnest([pred_class, yield_class]) AS l FROM both_),
s AS (SELECT l, count(*) FILTER (WHERE pred_class = l AND yield_class = l) AS tp, count(*) FILTER (WHERE pred_class = l) AS p, count(*) FILTER (WHERE yield_class = l) AS t FROM labels_, both_ GROUP BY l)
SELECT round(avg(coalesce(2.0 * tp / nullif(t + p, 0), 0)), 6) AS f1_macro, round(avg(coalesce(1.0 * tp / nullif(p, 0), 0)), 6) AS precision_macro, round(avg(coalesce(1.0 * tp / nullif(t, 0), 0)), 6) AS recall_macro,
round(sum(tp) / sum(t), 6) AS accuracy, CAST(sum(t) AS BIGINT) AS n FROM s""")
def classification_metrics(spark, sf_dir):
    return class_metrics(_tertiles(spark, sf_dir))


@query(f"WITH {PANEL}, {CLASSES} SELECT yield_class, round((SELECT count(*) FROM classed) / (3.0 * count(*)), 6) AS weight FROM classed GROUP BY yield_class")
def balanced_class_weights(spark, sf_dir):
    return class_weights(add_classes(panel_view(spark, sf_dir)))


def _profile(c: str) -> str:
    return f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, count({c}) AS known, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS \"distinct\" FROM gaps"


@query(f"WITH {PANEL}, {GAPS} {_profile('aod')} UNION ALL {_profile('pm')} UNION ALL {_profile('yield')}")
def missing_profile(spark, sf_dir):
    return columns.missing_profile(with_gaps(panel_view(spark, sf_dir)), ["aod", "pm", "yield"])


@query(f"WITH {PANEL}, {GAPS}, p AS ({_profile('aod')} UNION ALL {_profile('pm')} UNION ALL {_profile('yield')}) SELECT feature FROM p WHERE missing <= 0.35")
def feature_threshold(spark, sf_dir):
    return columns.kept_by_threshold(columns.missing_profile(with_gaps(panel_view(spark, sf_dir)), ["aod", "pm", "yield"]), 0.35)


@query(f"WITH {PANEL}, {GAPS} SELECT region, crop, year, round(coalesce(pm, aod), 6) AS pm FROM gaps")
def coalesce_duplicates(spark, sf_dir):
    twice = with_gaps(panel_view(spark, sf_dir)).select("region", "crop", "year", "pm", F.col("aod").alias("PM "))
    return columns.merged_duplicates(twice)


@query(f"WITH {PANEL} SELECT region, crop, year, round(aod, 6) AS aod, NULL::DOUBLE AS pm FROM panel WHERE year < 1998 UNION ALL SELECT region, crop, year, NULL, round(pm, 6) FROM panel WHERE year >= 1998")
def outer_union(spark, sf_dir):
    panel = panel_view(spark, sf_dir)
    return stack([panel.where("year < 1998").select("region", "crop", "year", "aod"), panel.where("year >= 1998").select("region", "crop", "year", "pm")])


@query(f"""WITH {BACKTEST} SELECT region, crop, year, 'yield_true' AS series, round(yield_true, 6) AS value FROM bt
UNION ALL SELECT region, crop, year, 'yield_pred', round(yield_pred, 6) FROM bt""")
def melt_backtest(spark, sf_dir):
    return columns.melted(forecast.backtest_linear(panel_view(spark, sf_dir)), ["region", "crop", "year"], ["yield_true", "yield_pred"])


@query(f"WITH {PANEL} SELECT region, crop, year, round(yield, 6) AS yield FROM panel ORDER BY yield DESC, region, crop, year LIMIT 12")
def top_k(spark, sf_dir):
    return panel_view(spark, sf_dir).select("region", "crop", "year", "yield").orderBy(F.desc("yield"), "region", "crop", "year").limit(12)


@query(f"WITH {PANEL} SELECT DISTINCT 'region' AS option, region AS value FROM panel UNION SELECT DISTINCT 'crop', crop FROM panel UNION SELECT DISTINCT 'year', CAST(year AS VARCHAR) FROM panel")
def distinct_options(spark, sf_dir):
    panel = panel_view(spark, sf_dir)
    parts = [views.options(panel, c).select(F.lit(c).alias("option"), "value") for c in ("region", "crop", "year")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {PANEL}, {GAPS} SELECT region, crop, year FROM gaps WHERE coalesce(aod, pm) IS NOT NULL")
def task_mask(spark, sf_dir):
    lagged = add_lags(with_gaps(panel_view(spark, sf_dir)))
    return lagged.where(columns.task_mask(["aod", "pm", "yield_lag1"], "regression")).select("region", "crop", "year")


@query(f"WITH {PANEL}, {GAPS} SELECT region, crop, year, round(coalesce(aod, 0), 6) AS aod, round(coalesce(pm, 0), 6) AS pm, CASE WHEN aod IS NULL THEN 1 ELSE 0 END AS aod_missing, CASE WHEN pm IS NULL THEN 1 ELSE 0 END AS pm_missing FROM gaps")
def impute_indicator(spark, sf_dir):
    return preprocess.imputed(with_gaps(panel_view(spark, sf_dir)), ["aod", "pm"]).drop("yield")


@query(f"WITH {PANEL} SELECT region, crop, year, round((yield - avg(yield) OVER ()) / stddev_pop(yield) OVER (), 6) AS yield, round((aod - avg(aod) OVER ()) / stddev_pop(aod) OVER (), 6) AS aod FROM panel")
def scale_numeric(spark, sf_dir):
    return preprocess.scaled(panel_view(spark, sf_dir), ["yield", "aod"]).drop("pm")


@query(f"WITH {PANEL} SELECT region, crop, year, CASE WHEN crop = 'BUILDING' THEN 1 ELSE 0 END AS crop_BUILDING, CASE WHEN crop = 'MACHINERY' THEN 1 ELSE 0 END AS crop_MACHINERY, 0 AS crop_none FROM panel")
def one_hot(spark, sf_dir):
    return preprocess.one_hot(panel_view(spark, sf_dir), "crop", ["BUILDING", "MACHINERY", "none"]).drop("yield", "aod", "pm")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for every region: a title, a unit row, a header and two rows of numbers."""
    cells = [(0, 0, "Report of the year"), (1, 1, "t/ha"), (2, 0, "Time (Year)"), (2, 1, "Yield"), (2, 2, " AOD\tmean"), (2, 3, "nan"), (3, 0, "1999"), (3, 1, "2.5"), (3, 2, "-0.5"), (4, 0, "Yearly yield"), (4, 1, "7")]
    each = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in cells))
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("sheet"), F.explode(each).alias("x")).select("sheet", "x.*")


@query("""WITH cells(row_, t, num) AS (VALUES (0, 'report of the year', 0), (1, 't/ha', 0), (2, 'time (year)', 0), (2, 'yield', 0), (2, 'aod mean', 0), (3, '1999', 1), (3, '2.5', 1), (3, '-0.5', 1), (4, 'yearly yield', 0), (4, '7', 1)),
s AS (SELECT row_, 9.0 + 0.2 * count(*) + 0.3 * (count(*) - sum(num)) - 3.5 * sum(num) / count(*) + 0.4 * max(CASE WHEN t LIKE '%aod%' THEN 1 ELSE 0 END) AS score
  FROM cells GROUP BY row_ HAVING bool_or(t LIKE 'time%' OR t LIKE 'year%') AND bool_or(t LIKE '%yield%'))
SELECT r_name AS sheet, row_ AS "row", round(CAST(score AS DOUBLE), 6) AS score, 2 AS header_row FROM region, s""")
def header_row_scoring(spark, sf_dir):
    cells = grid(spark, sf_dir)
    return header_scores(cells).join(header_rows(cells), "sheet")


@query(r"""WITH t AS (SELECT p_partkey, unnest([' ' || p_size || ' ', p_size || 'e1', p_type, '', p_size || 'd', '.5', 'nan', '1,000']) AS s, unnest(range(8)) AS k FROM part)
SELECT p_partkey, CAST(k AS INT) AS k, CASE WHEN regexp_matches(trim(s), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(s) AS DOUBLE) END AS x FROM t""")
def numeric_coercion(spark, sf_dir):
    size = F.col("p_size").cast("string")
    texts = F.array(F.concat(F.lit(" "), size, F.lit(" ")), F.concat(size, F.lit("e1")), F.col("p_type"), F.lit(""), F.concat(size, F.lit("d")), F.lit(".5"), F.lit("nan"), F.lit("1,000"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(texts).alias("k", "s")).select("p_partkey", "k", number(F.col("s")).alias("x"))


@query(f"WITH {PANEL} SELECT count(*) AS n_rows, count(DISTINCT region) AS n_regions, count(DISTINCT crop) AS n_crops, min(year) AS first_year, max(year) AS last_year FROM panel")
def overview(spark, sf_dir):
    return views.overview(panel_view(spark, sf_dir))


@query(f"WITH {PANEL}, {CLASSES}, {BACKTEST.removeprefix(PANEL + ', ')} SELECT 'Backtest' AS model, {ERRORS}, NULL::DOUBLE AS baseline_reg_rmse FROM bt UNION ALL SELECT 'Baseline', NULL, NULL, NULL, NULL, NULL, round(stddev_pop(yield), 6) FROM panel")
def metrics_summary(spark, sf_dir):
    panel = panel_view(spark, sf_dir)
    base = baselines(add_classes(panel)).select("baseline_reg_rmse")
    return views.metrics_summary({"Baseline": base, "Backtest": regression_metrics(forecast.backtest_linear(panel))})


@query("""WITH n AS (SELECT unnest([r_name || '_' || upper(n_name) || '_x', ' ' || r_name || ' ', r_name || '_']) AS sheet FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT sheet, trim(string_split(trim(sheet), '_')[1]) AS region, lower(trim(coalesce(string_split(trim(sheet), '_')[2], 'unknown'))) AS crop FROM n""")
def sheet_names(spark, sf_dir):
    pairs = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    forms = F.array(F.concat("r_name", F.lit("_"), F.upper("n_name"), F.lit("_x")), F.concat(F.lit(" "), "r_name", F.lit(" ")), F.concat("r_name", F.lit("_")))
    region, crop = sheet_identity(F.col("sheet"))
    return pairs.select(F.explode(forms).alias("sheet")).select("sheet", region.alias("region"), crop.alias("crop"))


@query("""SELECT r_name AS sheet, c AS col, l AS label FROM region, (VALUES (0, 'Time (Year)'), (1, 'Yield (t/ha)'), (2, 'AOD mean'), (3, 'AOD day')) AS t(c, l)""")
def merged_header_labels(spark, sf_dir):
    cells = grid(spark, sf_dir).where("row < 3")
    names = cells.select("sheet").distinct()
    more = F.array(F.struct(F.lit(2).alias("row"), F.lit(3).alias("col"), F.lit("day").alias("value")), F.struct(F.lit(0).alias("row"), F.lit(2).alias("col"), F.lit("AOD").alias("value")))
    cells = cells.where("value != 'nan'").unionByName(names.select("sheet", F.explode(more).alias("x")).select("sheet", "x.*"))
    return merged_headers(cells, header_rows(cells))


@query(f"WITH {PANEL}, {GAPS}, p AS ({_profile('aod')} UNION ALL {_profile('pm')} UNION ALL SELECT 'zero', 0, count(*), 1 FROM gaps) SELECT feature FROM p WHERE known > 0 AND \"distinct\" > 1")
def varying_features(spark, sf_dir):
    panel = with_gaps(panel_view(spark, sf_dir)).withColumn("zero", F.lit(0.0))
    return columns.varying(columns.missing_profile(panel, ["aod", "pm", "zero"]))


@query(f"WITH {PANEL}, g AS (SELECT *, CASE WHEN year % 3 <> 0 THEN crop END AS c FROM panel) SELECT region, crop, year, coalesce(c, (SELECT c FROM g WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)) AS c FROM g")
def mode_fill(spark, sf_dir):
    panel = panel_view(spark, sf_dir).select("region", "crop", "year", F.when(F.col("year") % 3 != 0, F.col("crop")).alias("c"))
    return preprocess.mode_filled(panel, ["c"])


@query(f"""WITH RECURSIVE {PAST}, s(scenario, f) AS (VALUES ('baseline', 1.0), ('polluted', 1.2))
SELECT scenario, year, round(yield_lag1 - 10 * aod * f - 5 * pm * f, 6) AS yield_pred FROM fc JOIN cf USING (region, crop), s WHERE region = 'ASIA' AND crop = 'BUILDING'""")
def scenario_lines(spark, sf_dir):
    base = forecast.recursive_forecast(with_gaps(panel_view(spark, sf_dir)), 10, ["aod", "pm"], carry=True)
    done = forecast.scenarios(base, ["aod"], ["pm"], F.col("yield_lag1") - 10 * F.col("aod") - 5 * F.col("pm"))
    return views.scenario_lines(done, "ASIA", "BUILDING", ["baseline", "polluted"])


@query(f"WITH {PANEL} SELECT region, crop, year, round(yield, 6) AS yield FROM panel WHERE region = 'ASIA' AND crop = 'BUILDING' ORDER BY year LIMIT 25")
def sample_rows(spark, sf_dir):
    return views.sample_rows(panel_view(spark, sf_dir).select("region", "crop", "year", "yield"), "ASIA", "BUILDING")


@query(f"WITH {BACKTEST} SELECT year, {ERRORS} FROM bt GROUP BY year ORDER BY year DESC LIMIT 5")
def last_metrics(spark, sf_dir):
    return views.last_metrics(regression_metrics(forecast.backtest_linear(panel_view(spark, sf_dir)), ["year"]))


@query(f"WITH {PANEL}, {LAGS} SELECT year, round(sqrt(avg((yield - lag1) ** 2)), 6) AS rmse, count(*) AS n FROM lagged WHERE lag1 IS NOT NULL GROUP BY year")
def persistence_by_year(spark, sf_dir):
    """The yield of the year before as the forecast."""
    lagged = add_lags(panel_view(spark, sf_dir), (1,))
    return regression_metrics(lagged, ["year"], "yield", "yield_lag1").select("year", "rmse", "n")


@query(f"WITH {PANEL} SELECT region, crop, count(*) AS n_known FROM panel WHERE yield IS NOT NULL AND year IS NOT NULL GROUP BY region, crop")
def known_history(spark, sf_dir):
    return panel_view(spark, sf_dir).dropna(subset=["year", "yield"]).groupBy("region", "crop").agg(F.count("yield").alias("n_known"))


# dashboard tables, masks, names and files


def _summary(spark, sf_dir):
    """The metrics summary of the built-in line: baselines, its errors, and the classes of its predictions."""
    panel = stored(panel_view(spark, sf_dir), "panel")
    classed = class_metrics(_tertiles(spark, sf_dir)).select(F.col("f1_macro").alias("oof_f1_macro"))
    errors = regression_metrics(forecast.backtest_linear(panel))
    return views.metrics_summary({"Baseline": baselines(add_classes(panel)), "BestClassifier": classed, "BestRegressor": errors.select(F.col("rmse").alias("oof_rmse")), "Backtest": errors})


@query(f"SELECT 'baseline' AS label, baseline_clf_macro_f1 AS f1_macro FROM ({ORACLES['baseline_metrics']}) UNION ALL SELECT 'best', f1_macro FROM ({ORACLES['classification_metrics']})")
def f1_comparison(spark, sf_dir):
    return views.f1_comparison(_summary(spark, sf_dir))


@query(f"SELECT 'baseline' AS label, baseline_reg_rmse AS rmse FROM ({ORACLES['baseline_metrics']}) UNION ALL SELECT unnest(['out of fold', 'backtest']), rmse FROM ({ORACLES['backtest_metrics_overall']})")
def rmse_comparison(spark, sf_dir):
    return views.rmse_comparison(_summary(spark, sf_dir))


@query(f"SELECT 'Backtest' AS model, rmse, r2 FROM ({ORACLES['backtest_metrics_overall']})")
def model_row(spark, sf_dir):
    return views.model_row(_summary(spark, sf_dir), "Backtest").select("model", "rmse", "r2")


@query(f"WITH {PANEL}, {GAPS}, l AS (SELECT *, lag(yield) OVER (PARTITION BY region, crop ORDER BY year) AS lag1 FROM gaps) SELECT region, crop, year FROM l WHERE coalesce(aod, pm, lag1) IS NOT NULL AND yield IS NOT NULL")
def train_mask(spark, sf_dir):
    """Training rows of a backtest: a lag alone will do as a feature."""
    return add_lags(with_gaps(panel_view(spark, sf_dir)), (1,)).where(columns.train_mask(["aod", "pm", "yield_lag1"])).select("region", "crop", "year")


@query("""WITH p AS (SELECT p_partkey, p_size, p_size % 5 AS k FROM part), t AS (SELECT CASE k WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE p_size END AS y, p_size + 1.5::DOUBLE AS p FROM p)
SELECT count(*) AS n, round(avg(abs(y - p)), 6) AS mae FROM t WHERE isfinite(y)""")
def finite_rows(spark, sf_dir):
    """Errors over rows of which some truths are NaN, infinite or null."""
    k, size = F.col("p_size") % 5, F.col("p_size").cast("double")
    truth = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k > 2, size)
    rows = table(spark, sf_dir, "part").select(truth.alias("yield_true"), (size + 1.5).alias("yield_pred"))
    return regression_metrics(rows).select("n", "mae")


@query(f"""WITH {PANEL}, g AS (SELECT * FROM panel WHERE region = 'ASIA' AND crop = 'BUILDING') SELECT region, crop, year, round(yield, 6) AS yield, NULL::DOUBLE AS no2, 'past_only' AS forecast_method FROM g""")
def safe_projection(spark, sf_dir):
    """A column that isn't there is null, a literal column is added, a column called otherwise is dropped."""
    rows = panel_view(spark, sf_dir).where("region = 'ASIA' and crop = 'BUILDING'").withColumn("forecast_method", F.lit("past_only"))
    return columns.project(rows, ["region", "crop", "year", "yield", "no2", "forecast_method"])


@query(r"""WITH n AS (SELECT DISTINCT p_brand || '  ' || p_type AS s FROM part)
SELECT s, 'pm ' || regexp_replace(lower(trim(s)), '\s+', ' ', 'g') || ' (ugm-3)' AS name FROM n""")
def canonical_names(spark, sf_dir):
    """Names in wide letters, with micro signs, tabs and blanks."""
    s = F.concat("p_brand", F.lit("  "), "p_type")
    names = table(spark, sf_dir, "part").select(s.alias("s")).distinct()
    return names.select("s", canonical_text(F.concat(F.lit("ＰＭ\t "), "s", F.lit(" (µgm-3) "))).alias("name"))


@query(f"WITH {PANEL} SELECT region, crop, year, round(yield, 6) AS yield FROM panel")
def files_there_and_back(spark, sf_dir):
    """The panel as a CSV file with a header, read again; joined by a file that isn't there, which is empty."""
    at = f"{own_dir(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(panel_view(spark, sf_dir).select("region", "crop", "year", "yield"), f"{at}/panel")
    schema = "region string, crop string, year int, yield double"
    return files.required_csv(spark, f"{at}/panel", schema).unionByName(files.optional_csv(spark, f"{at}/none", schema))


# no SQL form: models


@query()
def backtest_gbt(spark, sf_dir):
    """Of boosting with its default settings and derived columns, as a run fits it."""
    fit = lambda train: search.fit(train, "Boosting", "regression", ["aod", "pm", "year", "yield_lag1", "yield_lag2"]).predict
    done = forecast.backtest_model(stored(with_gaps(panel_view(spark, sf_dir)), "panel"), ["aod", "pm"], [1, 2], fit)
    return done.select("region", "crop", "year", "yield_true", "yield_pred")


@query()
def search_regressor(spark, sf_dir):
    """Scores by fold of candidates of every regressor, two of each kind."""
    full = add_lags(with_gaps(panel_view(spark, sf_dir)))
    kinds = [k for k in REGRESSORS if k != "SecondOrder"]
    return search.search(full, ["aod", "pm", "yield_lag1", "yield_lag2"], kinds=kinds, mode="full", most=2, feature_set="full")[2].select("candidate", "position", "fold", "score")


@query(f"""WITH {PANEL}, {LAGS}, k AS (SELECT yield AS y, aod AS a, pm AS p, lag1 AS l, year FROM lagged WHERE lag1 IS NOT NULL),
c AS (SELECT year, count(*) AS n, row_number() OVER (ORDER BY year DESC) AS back FROM k GROUP BY year),
f AS (SELECT year AS test_year, (SELECT sum(n) FROM c b WHERE b.year < x.year) AS n_train, n AS n_test FROM c x WHERE back <= CASE WHEN (SELECT count(*) FROM c) >= 6 THEN 4 ELSE 1 END),
g AS (SELECT row_number() OVER (ORDER BY test_year) - 1 AS fold, * FROM f WHERE n_train >= 8 AND n_test >= 4),
m AS (SELECT fold, test_year, any_value(n_train) AS n_train, any_value(n_test) AS n_test, avg(a) AS ma, avg(p) AS mp, avg(l) AS ml, avg(y) AS my,
  count(*) * covar_pop(a, a) AS aa, count(*) * covar_pop(p, p) AS pp, count(*) * covar_pop(l, l) AS ll, count(*) * covar_pop(a, p) AS ap, count(*) * covar_pop(a, l) AS al,
  count(*) * covar_pop(p, l) AS pl, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(p, y) AS py, count(*) * covar_pop(l, y) AS ly FROM g JOIN k ON k.year < test_year GROUP BY fold, test_year),
h AS (SELECT * REPLACE (aa + alpha AS aa, pp + alpha AS pp, ll + alpha AS ll), alpha FROM m, (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE)) v(alpha)),
d AS (SELECT *, aa * (pp * ll - pl * pl) - ap * (ap * ll - pl * al) + al * (ap * pl - pp * al) AS det FROM h),
w AS (SELECT *, (ay * (pp * ll - pl * pl) - ap * (py * ll - pl * ly) + al * (py * pl - pp * ly)) / det AS wa,
  (aa * (py * ll - pl * ly) - ay * (ap * ll - pl * al) + al * (ap * ly - py * al)) / det AS wp,
  (aa * (pp * ly - py * pl) - ap * (ap * ly - py * al) + ay * (ap * pl - pp * al)) / det AS wl FROM d),
r AS (SELECT fold, test_year, alpha, any_value(n_train) AS n_train, any_value(n_test) AS n_test, avg((y - my - wa * (a - ma) - wp * (p - mp) - wl * (l - ml)) ** 2) AS mse, var_pop(y) AS v FROM w JOIN k ON k.year = test_year GROUP BY fold, test_year, alpha)
SELECT CAST(fold AS INT) AS fold, test_year, alpha, CAST(n_train AS BIGINT) AS n_train, n_test, round(sqrt(mse), 6) AS rmse, round(1 - mse / v, 6) AS r2 FROM r""")
def search_penalties(spark, sf_dir):
    """Ridge regression of all folds and five penalties from one aggregate."""
    rows = stored(add_lags(panel_view(spark, sf_dir)).where("yield_lag1 is not null"), "rows")
    return ridge_path(rows, year_folds(rows), ["aod", "pm", "yield_lag1"], [0.01, 0.1, 1.0, 10.0, 100.0])


@query("""SELECT l_returnflag, count(v) AS n, round(quantile_cont(v, 1.0/3), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS m, round(quantile_cont(v, 2.0/3), 6) AS q2
FROM (SELECT l_returnflag, CASE WHEN l_quantity > 2 THEN l_extendedprice END AS v FROM lineitem) GROUP BY l_returnflag""")
def split_tertiles(spark, sf_dir):
    """Exact quantiles of line prices, from ranges of a thousand rows at most."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") > 2, F.col("l_extendedprice")).alias("v"))
    q = lambda i, name: F.get("q", i).alias(name)
    return exact_quantiles(rows, ["l_returnflag"], "v", [1 / 3, 0.5, 2 / 3], most=1000, parts=32).select("l_returnflag", "n", q(0, "q1"), q(1, "m"), q(2, "q2"))


def sheet_grid(spark, sf_dir):
    """The panel's groups as sheets of two layouts: a plain header; or a title, parents, units and a header, with a
    helper column of years and one of dates. Cells are text."""
    rows = panel_view(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("region", "crop").orderBy("year")))
    plain = F.col("crop") < "F"
    own = rows.select(F.concat_ws("_", "region", "crop").alias("sheet"), plain.alias("plain"), "n", "year", "yield", "aod", "pm")
    at = lambda col, value, row: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"))
    low, high = F.col("n"), F.col("n") + 3
    first = F.array(*(at(k, F.col(c), low) for k, c in enumerate(("year", "yield", "aod", "pm"))))
    second = F.array(at(0, F.col("year"), high), at(1, F.col("yield"), high), at(2, F.col("aod"), high), at(3, F.lit("n/a"), high), at(4, F.col("pm"), high), at(5, F.col("year"), high))
    cells = own.select("sheet", F.inline(F.when(F.col("plain"), first).otherwise(second)))
    heads = [(True, 0, k, v) for k, v in enumerate(("Year", "Yield", "AOD", "PM"))]
    heads += [(False, 0, 0, "Report"), (False, 1, 2, "AOD"), (False, 1, 3, "PM"), (False, 2, 1, "t/ha"), (False, 2, 3, "ppbv")]
    heads += [(False, 3, k, v) for k, v in ((0, "Time (Year)"), (1, "Yield of it"), (2, "avg"), (3, "years"), (4, "PM"), (5, "Date"))]
    lines = spark.createDataFrame(heads, "plain boolean, row int, col int, value string")
    return cells.unionByName(own.select("sheet", "plain").distinct().join(F.broadcast(lines), "plain").select("sheet", "row", "col", "value"))  # fifteen rows


@query(f"""WITH {PANEL} SELECT region, lower(crop) AS crop, year, round(yield, 6) AS yield, round(CASE WHEN crop < 'F' THEN aod END, 6) AS aod, round(CASE WHEN crop < 'F' THEN pm END, 6) AS pm,
round(CASE WHEN crop >= 'F' THEN aod END, 6) AS "aod avg", round(CASE WHEN crop >= 'F' THEN pm END, 6) AS "pm (ppbv)" FROM panel""")
def sheets_to_panel(spark, sf_dir):
    """Header rows, labels, names, roles and values of all sheets in one plan."""
    return build_panel(sheet_grid(spark, sf_dir))


@query()
def kernel_machine(spark, sf_dir):
    """The support vector regression of the panel: each row's prediction and multiplier, 0 outside the support set."""
    settings = {"C": 1.0, "epsilon": 0.1, "gamma": "scale"}
    full = stored(add_lags(panel_view(spark, sf_dir)), "panel")
    model = search.fit(full, "SVR", "regression", ["aod", "pm", "year", "yield_lag1", "yield_lag2"], settings, use_te=False)
    r, m = F.col("yield") - F.col("yield_pred"), model.arrays
    multiplier = float(m["C"]) * F.least(F.greatest((F.abs(r) - float(m["epsilon"])) / float(m["width"]), F.lit(0.0)), F.lit(1.0)) * F.signum(r)
    return model.predict(full).select("region", "crop", "year", "yield", "yield_pred", multiplier.alias("multiplier"))


@query(f"WITH {BACKTEST} SELECT year, series, round(value, 6) AS value FROM (SELECT year, 'yield_true' AS series, yield_true AS value, region, crop FROM bt UNION ALL SELECT year, 'yield_pred', yield_pred, region, crop FROM bt) WHERE region = 'ASIA' AND crop = 'BUILDING'")
def backtest_lines(spark, sf_dir):
    return views.backtest_lines(forecast.backtest_linear(panel_view(spark, sf_dir)), "ASIA", "BUILDING")


LINEAR = ("aod", "pm", "yield_lag1")
_moved = lambda f: " + ".join(f"{w} * {'y' if c == f else 'x'}.{c}" for w, c in zip((-10, -5, 1), LINEAR))
_lost = " UNION ALL ".join(
    f"SELECT feature, repeat, sum((x.yield - ({_moved(f)})) ** 2) AS sse FROM n x JOIN steps ON feature = '{f}' JOIN n y ON y.i = (a * x.i + b) % size GROUP BY ALL" for f in LINEAR
)


@query(f"""WITH {PANEL}, {LAGS},
n AS (SELECT yield, aod, pm, lag1 AS yield_lag1, row_number() OVER (ORDER BY md5(region || '|' || crop || '|' || year)) - 1 AS i FROM lagged WHERE lag1 IS NOT NULL),
w AS (SELECT count(*) AS size, sum((yield + 10 * aod + 5 * pm - yield_lag1) ** 2) AS sse, count(*) * var_pop(yield) AS total FROM n),
d AS (SELECT f.feature, r.repeat, md5(CAST(42 + 1000 * f.i + r.repeat AS VARCHAR)) AS digest FROM (VALUES ('aod', 0), ('pm', 1), ('yield_lag1', 2)) f(feature, i), range(10) r(repeat)),
s AS (SELECT feature, repeat, size, size // 4 + 1 + CAST('0x' || digest[1:8] AS BIGINT) % greatest(size - size // 4 - 1, 1) AS first, CAST('0x' || digest[9:16] AS BIGINT) % size AS b FROM d, w),
steps AS (SELECT feature, repeat, size, b, arg_min(c, (c - first + size) % size) AS a FROM s, range(1, (SELECT size + 1 FROM w)) k(c) WHERE gcd(c, size) = 1 GROUP BY ALL),
lost AS ({_lost})
SELECT feature, round(avg((lost.sse - w.sse) / total), 6) AS importance_mean, round(stddev_pop((lost.sse - w.sse) / total), 6) AS importance_std FROM lost, w GROUP BY feature""")
def perm_importance(spark, sf_dir):
    """Of a fixed linear predictor, all features and ten repeats."""
    rows = add_lags(panel_view(spark, sf_dir)).where("yield_lag1 is not null")
    predict = lambda r: r.withColumn("yield_pred", F.col("yield_lag1") - 10 * F.col("aod") - 5 * F.col("pm"))
    return search.permutation_importance(rows, list(LINEAR), predict)


@query(f"SELECT * FROM ({ORACLES['perm_importance']}) ORDER BY importance_mean DESC, feature LIMIT 2")
def top_importances(spark, sf_dir):
    return views.top_importances(perm_importance(spark, sf_dir), 2)


@query(f"""WITH {PANEL}, t AS (SELECT region, crop, year, CAST(CAST(round(yield * 1000000) AS BIGINT) AS VARCHAR) AS yield, CAST(CASE WHEN year % 2 = 0 OR region < 'B' THEN CAST(round(aod * 1000000) AS BIGINT) END AS VARCHAR) AS aod FROM panel),
d AS (SELECT md5(concat_ws(',', chr(39) || region || chr(39), chr(39) || crop || chr(39), chr(39) || year || chr(39), chr(39) || yield || chr(39), coalesce(chr(39) || aod || chr(39), 'N'))) AS h FROM t)
SELECT md5(concat_ws(':', sum(CAST('0x' || h[1:15] AS BIGINT)), bit_xor(CAST('0x' || h[16:30] AS BIGINT)), count(*), 'region,crop,year,yield,aod')) AS signature FROM d""")
def data_signature(spark, sf_dir):
    """Of the panel with gaps; numbers as whole millionths, which engines write alike."""
    panel = with_gaps(panel_view(spark, sf_dir)).withColumns({c: F.round(F.col(c) * 1_000_000).cast("long") for c in ("yield", "aod")})
    return spark.createDataFrame([(search.signature(panel, ["region", "crop", "year", "yield", "aod"]),)], "signature string")

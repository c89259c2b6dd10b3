"""The whole pipeline: panel, features, search, backtest, forecasts, scenarios, importance, report.

    python -m furrow.plans.run --data <workbook.xlsx, or a folder of sheet CSVs or of tables> --out outputs
"""

from __future__ import annotations

import argparse
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.config import Settings, settings
from furrow.operators import forecast, search
from furrow.operators.classes import add_classes, baselines
from furrow.operators.columns import feature_groups
from furrow.operators.lags import add_lags
from furrow.operators.metrics import regression_metrics
from furrow.plans import report, views
from furrow.session import local_session, scratch, stored
from furrow.sources import files, sheets
from furrow.sources.panel import panel_view
from furrow.sources.workbook import read_workbook


def prepared(panel: DataFrame, options: Settings) -> tuple[DataFrame, list[str]]:
    """The panel with lags and classes, and the names of its features."""
    full = add_classes(stored(add_lags(panel, options.lags), "lagged", keep=True), split=True)
    own = [c for c in ("aod", "pm") if c in panel.columns]
    names = sorted({*feature_groups(panel.columns)[2], *own})
    return full, [*names, *(f"yield_lag{k}" for k in options.lags)]


def run(spark: SparkSession, panel: DataFrame, out: str, options: Settings = Settings()) -> dict[str, DataFrame]:
    """Run every stage over a panel and write tables and report under ``out``. Tables that the result
    reads stay until ``session.clear``, or the end of a ``scratch`` around this call; all others go."""
    with scratch(spark):
        return _run(spark, panel, out, options)


def _run(spark: SparkSession, panel: DataFrame, out: str, options: Settings) -> dict[str, DataFrame]:
    seconds: dict[str, float] = {}

    @contextmanager
    def timed(stage: str):
        begin = time.time()
        yield
        seconds[stage] = time.time() - begin

    tables: dict[str, DataFrame] = {}
    lags = len(options.lags)
    with timed("features"):
        full, features = prepared(panel, options)
        full = stored(full, "panel", keep=True)
        panel = full.select(*panel.columns)
        plain = [f for f in features if not f.startswith("yield_lag")]
    with timed("tuning"):
        tune = {"mode": options.tune_mode, "n_splits": options.folds, "seed": options.seed, "use_te": options.use_target_mean, "smoothing": options.smoothing, "tertiles": options.tertiles, "feature_set": options.feature_set, "min_train": options.min_train_rows, "min_test": options.min_test_rows, "power": options.sample_weight_power, "most": options.most_candidates or None}
        reg, reg_info = search.cached_search(f"{out}/models/best_regressor", full, features, "regression", not options.use_cache, kinds=list(options.regressors) or None, **tune)
        clf, clf_info = search.cached_search(f"{out}/models/best_classifier", full, features, "classification", not options.use_cache, kinds=list(options.classifiers) or None, **tune)
        own = [f for f in reg_info["features"]]
    with timed("backtest"):
        def fit(train: DataFrame):
            return search.fit(train, reg_info["kind"], "regression", own, reg_info["params"], options.use_target_mean, options.smoothing, seed=options.seed).predict

        tables["backtest"] = stored(forecast.backtest_model(panel, [f for f in own if f in plain], list(options.lags), fit, options.backtest_years), "backtest", keep=True)
        tables["backtest_by_year"] = regression_metrics(tables["backtest"], ["year"]).orderBy("year")
    with timed("forecast"):
        for name, carry in (("forecast", False), ("forecast_past_only", True)):
            done = forecast.recursive_model(panel, [f for f in own if f in plain], lags, reg.predict, options.years_ahead, carry)
            tables[name] = stored(done.withColumn("forecast_method", F.lit("past_only" if carry else "trend_based")), name, keep=True)
            factors = {"baseline": 1.0, "clean_air": options.clean_scale, "polluted": options.polluted_scale}
            tables[name.replace("forecast", "scenarios")] = stored(forecast.scenarios(tables[name], list(options.aod_columns), list(options.pm_columns), reg.predict, factors), "scenarios", keep=True)
    with timed("importance"):
        tables["permutation_importance"] = search.permutation_importance(full.where(F.col("yield").isNotNull()), own, reg.predict, repeats=options.importance_repeats, seed=options.seed)
    spark_row = lambda d: spark.createDataFrame([d])
    scores = lambda info: {f"{part}_{k}": float(v) for part in ("oof", "train") for k, v in info.get(part, {}).items() if v is not None}
    tables["metrics_summary"] = views.metrics_summary({
        "Baseline": baselines(full),
        "BestClassifier": spark_row({"best_model_name": clf_info["best"], "cv_f1_macro": clf_info["cv"], **scores(clf_info)}),
        "BestRegressor": spark_row({"best_model_name": reg_info["best"], "cv_r2": reg_info["cv"], **scores(reg_info)}),
        "Backtest": regression_metrics(tables["backtest"]),
    })
    tables["panel"] = full
    with timed("write"):
        for name, df in tables.items():
            files.write_csv(df, f"{out}/{name}", single=name != "panel")
    tables["timing_summary"] = views.timings(spark, seconds)
    files.write_csv(tables["timing_summary"], f"{out}/timing_summary")
    text = report.summary(full, tables["metrics_summary"], tables["backtest_by_year"], tables["timing_summary"], sorted(tables))
    files.write_text(spark, text, f"{out}/reports/summary_txt")
    files.write_text(spark, report.as_html(text), f"{out}/reports/summary_html")
    return tables


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--out", default="outputs")
    p.add_argument("--config")
    p.add_argument("--tables", action="store_true", help="--data holds star-schema tables, not sheets")
    a = p.parse_args()
    spark = local_session()
    panel = panel_view(spark, a.data) if a.tables else sheets.build_panel(read_workbook(spark, a.data) if a.data.endswith(".xlsx") else sheets.read_grid(spark, a.data))
    run(spark, panel, a.out, settings(a.config))


if __name__ == "__main__":
    main()

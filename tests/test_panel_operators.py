"""Micro-panels with hand-made expectations, and a golden set of errors."""

from __future__ import annotations

import random
import re
import zipfile
from xml.sax.saxutils import escape

import pytest
from furrow.functions.scalars import canonical, finite, number
from furrow.operators import classes, columns, folds, forecast, lags, metrics, preprocess, quantiles, search, trend
from furrow.plans import report, run, views
from furrow.sources import files, panel, sheets
from pyspark.sql import functions as F

PANEL = "region string, crop string, year int, yield double"


def frame(spark, rows, schema=PANEL):
    return spark.createDataFrame(rows, schema)


def near(x, y):
    return x == y if x is None or y is None else x == pytest.approx(y, abs=1e-6)


def test_lags_are_positional(spark):
    got = lags.add_lags(frame(spark, [("R", "a", 2000, 1.0), ("R", "a", 2001, 2.0), ("R", "a", 2003, 4.0), ("R", "a", 2004, 8.0), (None, "a", 2000, 1.0), (None, "a", 2001, 2.0)]))
    assert [(r.year, r.yield_lag1, r.yield_lag2) for r in got.where("region is not null").orderBy("year").collect()] == [(2000, None, None), (2001, 1.0, None), (2003, 2.0, 1.0), (2004, 4.0, 2.0)]
    assert [r.yield_lag1 for r in got.where("region is null").collect()] == [None, None]


def test_tertiles(spark):
    eight = frame(spark, [("R", "a", 2000 + i, float(i)) for i in range(1, 9)] + [("R", "b", 2000, 5.0), ("R", "b", 2001, 9.0), ("R", "c", 2000, None)])
    got = {(r.crop, r["yield"]): r.yield_class for r in classes.add_classes(eight).collect()}
    assert [got["a", float(i)] for i in range(1, 9)] == [0, 0, 0, 1, 1, 2, 2, 2]
    assert (got["b", 5.0], got["b", 9.0], got["c", None]) == (0, 1, None)


def test_split_quantiles_equal_percentile(spark):
    """Ties, nulls, null keys, groups of one value, of few values and without any; also labels by them."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 7.0, 7.0, rng.gauss(0, 1e6), rng.random()])) for _ in range(3000)]
    rows += [("same", 3.5)] * 500 + [("none", None)] * 3 + [("one", 1.0)] + [("far", v) for v in (-1e308, 1e308, 0.0, 5e-324)] * 10
    t = frame(spark, [(c, "r", y) for c, y in rows], "crop string, region string, yield double").repartition(3)
    fractions = [0.0, 1 / 3, 0.5, 2 / 3, 1.0]
    want = {r.crop: r.q for r in t.groupBy("crop").agg(F.percentile("yield", fractions).alias("q")).collect()}
    for most, parts in ((1, 3), (20, 8), (10**6, 1024)):
        got = {r.crop: (r.n, r.q) for r in quantiles.exact_quantiles(t, ["crop"], "yield", fractions, most, parts).collect()}
        assert set(got) == set(want) and got["none"] == (0, None) and got["same"] == (500, [3.5] * 5)
        for c in ("a", "b", None, "one"):
            assert got[c][1] == pytest.approx(want[c], rel=1e-12)
    labels = lambda split: sorted(map(str, classes.add_classes(t.where("crop != 'far'"), split).collect()))
    assert labels(True) == labels(False)


def test_the_predictors_tertile_rule_takes_its_borders_below(spark):
    train = frame(spark, [("R", "a", 2000 + i, float(i)) for i in range(7)] + [("R", "b", 2000 + i, 10.0 * i) for i in range(3)])
    some = frame(spark, [("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", 1.0), ("x", 20.0), ("a", None)], "crop string, yield_pred double")
    got = {(r.crop, r.yield_pred): r.pred_class for r in classes.to_class(some, train).collect()}
    assert (got["a", 2.0], got["a", 4.0], got["a", None]) == (0, 1, None)  # crop thresholds 2 and 4
    assert (got["b", 1.0], got["b", 3.0], got["x", 20.0]) == (0, 1, 2)  # three rows: thresholds of all


def test_target_means(spark):
    train = frame(spark, [("R", "a", 2000, 1.0), ("R", "a", 2001, 3.0), ("R", "b", 2000, 8.0)])
    means = classes.target_means(train)
    got = {r.crop: r for r in classes.add_target_means(frame(spark, [("R", c, 2002, None) for c in "abc"]), means).collect()}
    assert [round(got[c].te_crop, 6) for c in "abc"] == [3.666667, 4.363636, 4.0]
    assert near(got["c"].te_region_crop, 4.0)


def test_trend(spark):
    rows = [("R", "a", y, v) for y, v in ((2000, 1.0), (2001, 3.0), (2002, None), (2003, 9.0))] + [("R", "b", 2000, 7.0), ("R", "b", 2001, None)] + [("R", "c", 2000 + i, 5.0) for i in range(3)] + [("R", "d", 2000, None)]
    got = {r.crop: r["yield"] for r in trend.trend_features(frame(spark, rows), ["yield"], F.lit(2004)).collect()}
    assert near(got["a"], 11.571429) and (got["b"], got["c"], got["d"]) == (7.0, 5.0, None)
    last = {r.crop: r["yield"] for r in trend.carried(frame(spark, rows), ["yield"]).collect()}
    assert last == {"a": 9.0, "b": 7.0, "c": 5.0, "d": None}


def test_short_histories_pad_in_two_ways(spark):
    short = frame(spark, [("R", "a", 2000, 10.0), ("R", "a", 2001, 20.0), ("R", "a", 2002, 30.0)])
    past = trend.backtest_lags(short, [1, 2, 3], frame(spark, [(2002,)], "test_year int")).first()
    assert (past.yield_lag1, past.yield_lag2, past.yield_lag3) == (20.0, 10.0, 20.0)
    assert lags.last_yields(short.where("year < 2002"), 3).first().last_yields == [10.0, 10.0, 20.0]


def test_lag_statistics(spark):
    five = frame(spark, [(5.0, 3.0, None, 1.0, 2.0)], ", ".join(f"yield_lag{k} double" for k in range(1, 6)))
    r = lags.add_lag_statistics(five).first()
    expected = {"last": 5, "count_nonnull": 4, "mean_2": 4, "mean_3": 4, "mean_5": 2.75, "std_3": 1, "std_5": 1.479020, "min_3": 3, "max_3": 5, "min_5": 1, "max_5": 5, "slope_3": -2, "slope_5": -0.8, "momentum_1": 2, "momentum_2": None, "momentum_4": 3, "ratio_last_mean3": 1.25}
    assert all(near(r[f"yield_lag_{k}"], v) for k, v in expected.items())
    two = lags.add_lag_statistics(five.select("yield_lag1", "yield_lag2")).first()
    assert all(two[f"yield_lag_{k}"] is None for k in expected if k.endswith(("_3", "_5", "mean3", "momentum_2", "momentum_4")))
    none = lags.add_lag_statistics(five.select(F.lit(1).alias("x"))).first()
    assert none.yield_lag_last is None and none.yield_lag_mean_2 is None


def test_regression_metrics(spark):
    kind = "yield_true double, yield_pred double"
    r = metrics.regression_metrics(frame(spark, [(0.0, 1.0), (2.0, 2.0), (4.0, 3.0), (float("nan"), 1.0), (1.0, None)], kind)).first()
    assert [round(x, 6) for x in (r.rmse, r.mae, r.mape, r.r2)] == [0.816497, 0.666667, 12.5, 0.75] and r.n == 3
    assert metrics.regression_metrics(frame(spark, [(1.0, 1.0), (1.0, 2.0)], kind)).first().r2 is None
    empty = metrics.regression_metrics(frame(spark, [], kind)).first()
    assert (empty.rmse, empty.mae, empty.mape, empty.r2, empty.n) == (None, None, None, None, 0)


def test_class_metrics(spark):
    r = classes.class_metrics(frame(spark, [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (2, 0)], "yield_class int, pred_class int")).first()
    assert near(r.f1_macro, 1 / 6) and near(r.accuracy, 1 / 3) and r.n == 6
    base = classes.baselines(frame(spark, [(0, 1.0), (0, 1.0), (1, 2.0), (1, 2.0), (2, 3.0), (2, 3.0)], "yield_class int, yield double")).first()
    assert near(base.baseline_clf_macro_f1, 1 / 6)


def test_folds(spark):
    make = lambda groups, years: frame(spark, [(f"R{g}", "a", y, 1.0) for g in range(groups) for y in years])
    assert [(r.test_year, r.n_train, r.n_test) for r in folds.year_folds(make(3, range(2000, 2007))).collect()] == [(2006, 18, 3)]
    assert [(r.test_year, r.n_train, r.n_test) for r in folds.year_folds(make(5, range(2000, 2007))).orderBy("fold").collect()] == [(2003, 15, 5), (2004, 20, 5), (2005, 25, 5), (2006, 30, 5)]
    assert folds.year_folds(make(5, (2000, 2001))).collect() == []
    rows = folds.folded(make(5, range(2000, 2007)), folds.year_folds(make(5, range(2000, 2007))))
    assert rows.where("is_train and year >= test_year").count() == 0


def test_scenarios(spark):
    base = frame(spark, [("R", "a", 2021, 1.0, 1.0, 3.0)], "region string, crop string, year int, aod double, pm double, yield_pred double")
    once = {r.scenario: (round(r.aod, 6), round(r.pm, 6)) for r in forecast.scenarios(base, ["AOD", "Aod"], ["pm"]).collect()}
    assert once == {"baseline": (1.0, 1.0), "clean_air": (0.8, 0.8), "polluted": (1.2, 1.2)}
    twice = {r.scenario: (round(r.aod, 6), round(r.pm, 6)) for r in forecast.scenarios(base, ["AOD", "Aod"], ["pm"], legacy_double_scale=True).collect()}
    assert twice == {"baseline": (1.0, 1.0), "clean_air": (0.64, 0.8), "polluted": (1.44, 1.2)}


def test_names():
    assert [canonical(x) for x in ("AOD ", "PM2.5 (μgm-3)", "CH4\n avg")] == ["aod", "pm2.5 ugm-3", "ch4 avg"]
    assert columns.feature_groups(["year", "AOD mean", "skin temp", "wind", "co day ppbv", "day", "yield_lag1"]) == (["AOD mean", "co day ppbv"], ["skin temp", "day"], ["AOD mean", "co day ppbv", "day", "skin temp"])
    assert columns.resolved(["AOD ", "x"], ["aod", "Aod", "pm"]) == ["AOD "]
    assert lags.lag_columns(["yield_lag2", "yield_lag_1", "x"]) == [(1, "yield_lag_1"), (2, "yield_lag2")]


def test_numbers(spark):
    texts = [" 12 ", "1e3", "", "abc", "1,000", "1_000", "1d", "nan", ".5", "-3."]
    got = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", number(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [12.0, 1000.0, None, None, None, None, None, None, 0.5, -3.0]
    assert [r.f for r in frame(spark, [(1, 1.0), (2, float("inf")), (3, float("nan")), (4, None)], "i int, x double").orderBy("i").select(finite(F.col("x")).alias("f")).collect()] == [True, False, False, False]


def test_column_selection(spark):
    rows = frame(spark, [(1.0, None, 5.0, None), (2.0, None, 5.0, 1.0), (None, None, 5.0, None)], "a double, b double, c double, d double")
    profile = columns.missing_profile(rows, rows.columns)
    assert {r.feature for r in columns.varying(profile).collect()} == {"a", "d"}
    assert {r.feature for r in columns.kept_by_threshold(profile, 0.35).collect()} == {"a", "c"}
    twice = columns.merged_duplicates(rows.toDF("PM", "x", "y", "pm "))
    assert twice.columns == ["pm", "x", "y"] and [r.pm for r in twice.collect()] == [1.0, 2.0, None]
    assert columns.project(rows, ["d", "z"]).columns == ["d", "z"]
    assert columns.numeric(frame(spark, [("1", "x")], "a string, b string"), ["a", "b"]).first() == (1.0, None)


def test_preprocess(spark):
    rows = frame(spark, [(1.0, "u"), (3.0, "v"), (5.0, "v"), (None, None)], "a double, s string")
    assert [(r.a, r.a_missing) for r in preprocess.imputed(rows, ["a"]).collect()] == [(1.0, 0), (3.0, 0), (5.0, 0), (0.0, 1)]
    assert near(preprocess.scaled(rows, ["a"]).first().a, -(1.5**0.5))
    assert [r.s for r in preprocess.mode_filled(rows, ["s"]).collect()] == ["u", "v", "v", "v"]
    assert [(r.s_u, r.s_v) for r in preprocess.one_hot(rows, "s", preprocess.levels(rows, "s")).collect()] == [(1, 0), (0, 1), (0, 1), (0, 0)]


def test_recursion_feeds_predictions_back(spark):
    rows = frame(spark, [("R", "a", 2000 + i, 2.0**i) for i in range(5)] + [("S", "a", 2000, 3.0), ("S", "a", 2001, 6.0)])
    got = {(r.region, r.year): r.yield_pred for r in forecast.recursive_forecast(rows, 3).collect()}
    assert all(near(got["R", 2004 + k], 16.0 * 2**k) for k in (1, 2, 3))
    assert near(got["S", 2005], 12.0)  # from the global last year on, with its own last yield
    double = lambda r: r.withColumn("yield_pred", 2 * F.col("yield_lag1"))
    same = {(r.region, r.year): r.yield_pred for r in forecast.recursive_model(rows, [], 2, double, 3).collect()}
    assert all(near(same[k], v) for k, v in got.items())


#: Published predictions of one year (region, crop, year, truth, prediction).
GOLDEN = """GKP maize 2018 0.4570963806 1.31628221;GKP rice 2018 2.55 2.3546666;GKP wheat 2018 4.23599819 3.206282051;PYG maize 2018 2.19 1.402840129;PYG rice 2018 2.74 2.441335489;PYG wheat 2018 3.761437644 2.747434941;SNB maize 2018 0.93 1.206117391;SNB rice 2018 2.72 2.072221748;SNB wheat 2018 2.356966503 2.516254194;VNS maize 2018 1.774060021 1.76164622;VNS rice 2018 2.549005201 2.392193824;VNS wheat 2018 3.381168635 3.069894298"""


def test_golden_errors(spark):
    """Published predictions of one year and their published errors."""
    rows = [(a, b, int(y), float(t), float(p)) for a, b, y, t, p in (line.split() for line in GOLDEN.split(";"))]
    (r,) = metrics.regression_metrics(frame(spark, rows, "region string, crop string, year int, yield_true double, yield_pred double"), ["year"]).collect()
    assert [round(x, 6) for x in (r.rmse, r.mae, r.mape, r.r2)] == [0.592773, 0.478979, 30.838128, 0.669645] and r.n == 12


def test_models_get_what_is_derived(spark, sf_dir, tmp_path):
    full = lags.add_lags(panel.panel_view(spark, sf_dir), (1, 2)).where("year > 1996")
    model = search.fit(full, "Ridge", "regression", ["aod", "yield_lag1"], {"alpha": 0.1}, smoothing=3.0)
    assert model.numeric == ["aod", "yield_lag1", *search.STATISTICS, *search.TE, *search.INTERACTIONS] and len(search.STATISTICS) == 17
    model.save(str(tmp_path / "m"), "key")
    one, again = (sorted((r.region, r.crop, r.year, round(r.yield_pred, 6)) for r in m.predict(full).collect()) for m in (model, search.load(str(tmp_path / "m"), "key")))
    assert one == again and len(one) == full.count()
    assert search.fit(full, "Ridge", "regression", ["aod"], use_te=False).numeric == ["aod", *search.STATISTICS]
    search.fit(full, "Ridge", "regression", ["aod"], {"alpha": 10.0}).save(str(tmp_path / "m"), "other")  # what was loaded before still predicts
    assert sorted((r.region, r.crop, r.year, round(r.yield_pred, 6)) for r in model.predict(full).collect()) == one
    assert search.load(str(tmp_path / "m"), "key") is None


def test_the_run_passes_its_settings_on(spark, sf_dir, tmp_path, monkeypatch):
    from furrow.config import Settings

    seen = []

    def stop(*args, **options):
        seen.append(options)
        raise InterruptedError

    monkeypatch.setattr(search, "cached_search", stop)
    with pytest.raises(InterruptedError):
        run.run(spark, panel.panel_view(spark, sf_dir), str(tmp_path), Settings(use_target_mean=False, smoothing=3.0, tertiles="refit", feature_set="mid", min_train_rows=5, min_test_rows=2))
    wanted = {"use_te": False, "smoothing": 3.0, "tertiles": "refit", "feature_set": "mid", "min_train": 5, "min_test": 2}
    assert {k: seen[0].get(k) for k in wanted} == wanted


def test_the_backtest_fits_the_model_that_was_found(spark, sf_dir, tmp_path, monkeypatch):
    from furrow.config import Settings

    found, fitted = {"features": ["aod", "yield_lag1"], "best": "Ridge x", "kind": "Ridge", "params": {"alpha": 0.1}}, []

    def stop(train, kind, task, names, params=None, *rest, **options):
        fitted.append((kind, names, params))
        raise InterruptedError

    monkeypatch.setattr(search, "cached_search", lambda *args, **options: (None, found))
    monkeypatch.setattr(search, "fit", stop)
    with pytest.raises(InterruptedError):
        run.run(spark, panel.panel_view(spark, sf_dir), str(tmp_path), Settings())
    assert fitted == [("Ridge", ["aod", "yield_lag1"], {"alpha": 0.1})]


@pytest.mark.parametrize("n", [1, 2, 3, 12, 50, 97])
def test_steps_are_permutations(n):
    for seed in range(30):
        a, b = search.step_of(n, seed)
        assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_shuffled_copies_are_permutations(spark):
    rows = search.numbered(frame(spark, [(f"r{i % 5}", "c", i, float(2 * i)) for i in range(50)], "region string, crop string, year int, b double"))
    got = search.shuffled(rows, "b", [search.step_of(50, s) for s in range(3)], 50).collect()
    assert len(got) == 150
    for k in range(3):
        own = {r.year: r.b for r in got if r.repeat == k}
        assert sorted(own.values()) == [2.0 * i for i in range(50)] and any(own[i] != 2 * i for i in own)


def test_importance_equals_one_permutation_at_a_time(spark):
    values = [(f"r{i % 4}", "c", 2000 + i // 4, float(i % 7), float((i * 5) % 11), float(i % 7) + 0.1 * ((i * 5) % 11)) for i in range(60)]
    rows = frame(spark, values, "region string, crop string, year int, a double, b double, yield double")
    predict = lambda r: r.withColumn("yield_pred", F.col("a") + 0.1 * F.col("b"))
    got = {r.feature: (r.importance_mean, r.importance_std) for r in search.permutation_importance(rows, ["a", "b"], predict, repeats=4).collect()}
    every = sorted(search.numbered(rows).collect(), key=lambda r: r._n)
    mean = sum(r["yield"] for r in every) / 60
    total = sum((r["yield"] - mean) ** 2 for r in every)
    for i, f in enumerate("ab"):
        lost = []
        for k in range(4):
            a, b = search.step_of(60, 42 + 1000 * i + k)
            other = [every[(a * r._n + b) % 60][f] for r in every]
            lost.append(sum((r["yield"] - (x + 0.1 * r.b if f == "a" else r.a + 0.1 * x)) ** 2 for r, x in zip(every, other)) / total)
        center = sum(lost) / 4
        assert got[f] == pytest.approx((center, (sum((x - center) ** 2 for x in lost) / 4) ** 0.5))
    assert got["a"][0] > got["b"][0] > 0


def test_wide_sheets_keep_all_columns(spark, tmp_path):
    names = ["Year", "Yield", *(f"feature {i}" for i in range(298))]
    (tmp_path / "GKP_Rice.csv").write_text(",".join(names) + "\n" + "\n".join(",".join([str(2000 + y), "1.5", *(str(i + y / 4) for i in range(298))]) for y in range(3)) + "\n")
    (tmp_path / "VNS_Rice.csv").write_text('Year,"Yield, in\nall"\n2000,1\n')
    grid = sheets.read_grid(spark, str(tmp_path))
    assert {r.sheet: r.n for r in grid.groupBy("sheet").agg((F.max("col") + 1).alias("n")).collect()} == {"GKP_Rice": 300, "VNS_Rice": 2}
    assert grid.where("col = 299 and row = 2").first().value == "297.25"


SHEET = """Report,,,,
,,AOD,,
,t/ha,,mm/day,
Time (Year),Yield of rice,avg,precip,date
2000,1.5,0.3,2,2000
2001,2.5,,3,2001
2002,,0.5,4,2002
2003,abc,0.5,4,2003
2004,3.5,0.6,nan,2004
"""


def test_sheets_become_a_panel(spark, tmp_path):
    (tmp_path / "GKP_Rice.csv").write_text(SHEET)
    (tmp_path / "VNS_wheat_x.csv").write_text("Year,Yield,ozone\n2000,1,7\n2001,2,8\n")
    grid = sheets.read_grid(spark, str(tmp_path)).cache()
    assert {r.sheet: r.header_row for r in sheets.header_rows(grid).collect()} == {"GKP_Rice": 3, "VNS_wheat_x": 0}
    got = sheets.build_panel(grid)
    assert got.columns == ["region", "crop", "year", "yield", "aod avg", "precip (mm/day)", "ozone"]
    rows = [tuple(r) for r in got.orderBy("region", "year").collect()]
    assert rows == [("GKP", "rice", 2000, 1.5, 0.3, 2.0, None), ("GKP", "rice", 2001, 2.5, None, 3.0, None), ("GKP", "rice", 2004, 3.5, 0.6, None, None), ("VNS", "wheat", 2000, 1.0, None, None, 7.0), ("VNS", "wheat", 2001, 2.0, None, None, 8.0)]
    assert panel.duplicate_keys(got).count() == 0
    with pytest.raises(ValueError):
        sheets.clean_sheet(frame(spark, [("a", 0, 0, "x"), ("a", 1, 0, "5")], "sheet string, row int, col int, value string"), "a")


def write_workbook(path, book: dict[str, list[list]]):
    """A workbook with shared, inline and plain cells; None is no cell."""
    shared, parts = [], []

    def xml(r: int, c: int, v) -> str:
        letters, n = "", c + 1
        while n:
            n, k = divmod(n - 1, 26)
            letters = chr(65 + k) + letters
        at = f'r="{letters}{r + 1}"'
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v!r}</v></c>"
        if v.startswith("="):
            return f'<c {at} t="e"><f>1/0</f><v>#DIV/0!</v></c>'
        if len(v) % 2:
            return f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        shared.append(f"<si><r><t>{escape(v[:1])}</t></r><r><t>{escape(v[1:])}</t></r><rPh><t>no</t></rPh></si>")
        return f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'

    for rows in book.values():
        body = "".join(f'<row r="{i + 1}">' + "".join(xml(i, j, v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
        parts.append(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(book)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(parts))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(shared) + "</sst>")
        for i, part in enumerate(parts):
            z.writestr(f"xl/worksheets/s{i}.xml", part)


def test_a_workbook_gives_the_panel_of_its_csv_form(spark, tmp_path):
    from furrow.sources.workbook import read_workbook

    own = [[None if v == "" else float(v) if re.fullmatch(r"[0-9.]+", v) else v for v in line.split(",")] for line in SHEET.strip().split("\n")]
    other = [["Year", "Yield", "ozone", *[None] * 25, "SO2"], [2000, 1, 7e-7, *[None] * 25, 5], [2001, 2, True, *[None] * 25, "=1/0"]]
    write_workbook(tmp_path / "book.xlsx", {"GKP_Rice": own, "VNS_wheat_x": other, "LKO_Maize": [["Year", "Yield"], [2000, 3]]})
    grid = read_workbook(spark, str(tmp_path / "book.xlsx"))
    assert grid.rdd.getNumPartitions() == 3
    assert {(r.row, r.col): r.value for r in grid.where("sheet = 'VNS_wheat_x' and row > 0").collect()} == {(1, 0): "2000", (1, 1): "1", (1, 2): "0.0000007", (1, 28): "5", (2, 0): "2001", (2, 1): "2", (2, 2): "True"}
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/GKP_Rice.csv").write_text(SHEET)
    (tmp_path / "csv/VNS_wheat_x.csv").write_text(f"Year,Yield,ozone{',' * 26}SO2\n2000,1,0.0000007{',' * 26}5\n2001,2,True{',' * 26}\n")
    (tmp_path / "csv/LKO_Maize.csv").write_text("Year,Yield\n2000,3\n")
    one, two = (sheets.build_panel(g) for g in (grid, sheets.read_grid(spark, str(tmp_path / "csv"))))
    assert one.columns == two.columns == ["region", "crop", "year", "yield", "aod avg", "precip (mm/day)", "ozone", "so2"]
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 6


def test_jobs_do_not_grow_with_the_sheets(spark):
    def jobs(n: int) -> int:
        cells = [(f"R{i}_c", 0, k, v) for i in range(n) for k, v in enumerate(("Year", "Yield", "aod"))] + [(f"R{i}_c", r, k, str(v)) for i in range(n) for r in (1, 2) for k, v in enumerate((2000 + r, 1.5, 0.2))]
        grid = frame(spark, cells, "sheet string, row int, col int, value string")
        spark.sparkContext.setJobGroup(f"sheets {n}", "")
        assert sheets.build_panel(grid).count() == 2 * n
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sheets {n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return done

    assert jobs(2) == jobs(30)


def test_sheets_without_year_or_yield_are_errors(spark):
    good = [("a_b", 0, 0, "Year"), ("a_b", 0, 1, "Yield"), ("a_b", 1, 0, "2000"), ("a_b", 1, 1, "1")]
    for label, other in (("yield", [("c_d", 0, 0, "Year"), ("c_d", 1, 0, "2000")]), ("year", [("c_d", 0, 0, "Yield"), ("c_d", 1, 0, "5")]), ("year", [("c_d", 0, 0, "Year")])):
        with pytest.raises(ValueError, match=f"sheet c_d: no {label}"):
            sheets.build_panel(frame(spark, good + other, "sheet string, row int, col int, value string"))
    unnamed = good[:0] + [("e_f", 0, 0, "Yield"), ("e_f", 0, 1, "x"), *(("e_f", r, c, str(v)) for r in (1, 2, 3) for c, v in enumerate((r, 2000 + r)))]
    assert [r.year for r in sheets.build_panel(frame(spark, unnamed, "sheet string, row int, col int, value string")).orderBy("year").collect()] == [2001, 2002, 2003]


def test_files(spark, tmp_path):
    schema = "a int, b string"
    with pytest.raises(FileNotFoundError):
        files.required_csv(spark, str(tmp_path / "no"), schema)
    assert files.optional_csv(spark, str(tmp_path / "no"), schema).collect() == []
    files.write_csv(frame(spark, [(1, "x")], schema), str(tmp_path / "yes"))
    assert files.required_csv(spark, str(tmp_path / "yes"), schema).first() == (1, "x")
    files.write_json(spark, {"k": [1]}, str(tmp_path / "json"))
    assert files.tolerant_json(spark, str(tmp_path / "json")) == {"k": [1]}
    assert files.tolerant_json(spark, str(tmp_path / "none")) == {}


def test_the_whole_run(spark, sf_dir, tmp_path):
    from furrow.config import Settings

    options = Settings(tune_mode="fast", years_ahead=2, backtest_years=1, importance_repeats=1, folds=2, most_candidates=2, regressors=("Ridge", "Boosting"), classifiers=("LinearSVC", "Boosting"))
    small = panel.panel_view(spark, sf_dir)
    tables = run.run(spark, small, str(tmp_path / "out"), options)
    assert tables["forecast"].count() == 50 and tables["scenarios"].count() == 150 and tables["backtest"].count() == 25
    text = files.text(spark, str(tmp_path / "out/reports/summary_txt"))
    assert "Rows: 175" in text and "Years: 1995 to 2001" in text and "total" in text
    assert [r.label for r in views.rmse_comparison(tables["metrics_summary"]).collect()]
    assert report.as_html("a<b").count("&lt;") == 1
    again = files.dashboard(spark, str(tmp_path / "out"))
    assert again["panel"].count() == 175 and again["scenarios"].count() == 150 and None not in again.values()
    assert report.of_files(spark, str(tmp_path / "out")).split("Seconds")[0] == text.split("Seconds")[0]
    lines = {r.label: r.f1_macro for r in views.f1_comparison(tables["metrics_summary"]).collect()}
    assert set(lines) == {"baseline", "best"} and lines["best"] is not None
    assert views.model_row(tables["metrics_summary"], "Backtest").first().rmse is not None
    assert views.top_importances(tables["permutation_importance"], 2).count() == 2


def test_a_report_without_files(spark, tmp_path):
    text = report.of_files(spark, str(tmp_path / "nowhere"))
    assert "Rows: 0" in text and "RMSE: N/A" in text
    with pytest.raises(FileNotFoundError):
        files.dashboard(spark, str(tmp_path / "nowhere"))


def test_settings_of_a_nested_file(tmp_path):
    from furrow.config import settings

    (tmp_path / "own.yaml").write_text("""# own
data_path: "my data, (3) #4.xlsx"  # a name
random_state: 7
cv:
  n_splits: 3
  min_samples_cv: 10
forecast:
  years_ahead: 3  # horizon
scenario:
  clean_scale: 0.7
  aod_cols: ["AOD", "Aod, x"]
  pm_cols:
    - PM2.5 (ugm-3)   # unit
    - 'pm''s'
lags: [1,
  2, 3]
other:
  deep:
    name: x
""")
    own = settings(str(tmp_path / "own.yaml"), {"FURROW_OUTPUTS_DIR": "there"})
    assert (own.data_path, own.seed, own.folds, own.min_train_rows, own.min_test_rows, own.years_ahead) == ("my data, (3) #4.xlsx", 7, 3, 10, 5, 3)
    assert (own.clean_scale, own.polluted_scale, own.aod_columns, own.pm_columns) == (0.7, 1.2, ("AOD", "Aod, x"), ("PM2.5 (ugm-3)", "pm's"))
    assert own.lags == (1, 2, 3) and own.outputs_dir == "there" and own.extra == {"name": "x"}
    (tmp_path / "own.json").write_text('{"cv": {"n_splits": 2}, "lags": [1]}')
    assert settings(str(tmp_path / "own.json"), {}).folds == 2 and settings(str(tmp_path / "none"), {}).folds == 4

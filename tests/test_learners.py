"""Learners against brute force and optimality conditions, in one block and spread over a table."""

from __future__ import annotations

import gc
import itertools
import json
import time

import numpy as np
import pytest
from furrow.learners import blocks, boosting, catalogue, extra_trees, kernel, perceptron
from furrow.operators import lags, search
from furrow.session import scratch
from furrow.sources import panel


def data(n=160, d=9, seed=0, classes=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:, -3:] = x[:, -3:] > 0.3
    y = 3 + 2 * x[:, 0] + np.sin(2 * x[:, 1]) + x[:, 2] * x[:, 3] + 0.3 * rng.normal(size=n)
    if classes:
        y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    return blocks.Block(x, y, rng.uniform(0.5, 1.5, n), rng.integers(0, 1 << 62, n))


def spread(spark, b, parts=5):
    rows = [(x.tolist(), float(y), float(w), int(u)) for x, y, w, u in zip(b.x, b.y, b.w, b.u)]
    return blocks.Spread(spark.createDataFrame(rows, blocks.SCHEMA).repartition(parts))


# kernel machine


@pytest.mark.parametrize(("c", "epsilon", "gamma"), [(0.3, 0.2, "auto"), (1.0, 0.1, "scale"), (10.0, 0.03, 0.05)])
def test_kernel_machine_is_optimal(c, epsilon, gamma):
    """Its multipliers meet every condition of the dense problem, and both objectives agree."""
    b = data()
    m = kernel.fit_svr(blocks.Held(b), 6, c, epsilon, gamma)
    z = blocks.scaled(b.x, m["mean"], m["deviation"])
    k = np.exp(-m["gamma"] * kernel.squared_distances(z, z))
    beta = kernel.multipliers(m, b.x, b.y) * b.w
    f = kernel.predict_svr(m, b.x)
    assert np.abs(k @ beta + m["bias"] - f).max() < 1e-4  # the function is that of the multipliers
    assert abs(beta.sum()) < 1e-4 and (np.abs(beta) <= c * b.w + 1e-9).all()
    r = np.abs(b.y - f)
    assert (np.abs(beta[r < epsilon - 1e-9]) == 0).all()
    assert np.abs(np.abs(beta) - c * b.w)[r > epsilon + 1e-3 * max(epsilon, 1e-3)].max(initial=0) < 1e-9
    primal = beta @ k @ beta / 2 + c * (b.w * np.maximum(r - epsilon, 0)).sum()
    dual = b.y @ beta - epsilon * np.abs(beta).sum() - beta @ k @ beta / 2
    assert abs(primal - dual) < 1e-3 * max(abs(primal), 1)
    assert m["n_support"] == (np.abs(beta) > 0).sum()


def test_kernel_machine_against_coordinate_ascent():
    """The dense dual without a bias term's constraint is solved two multipliers at a time."""
    b = data(40)
    b.w[:] = 1.0
    m = kernel.fit_svr(blocks.Held(b), 6, 1.0, 0.1, 0.1)
    z = blocks.scaled(b.x, m["mean"], m["deviation"])
    k = np.exp(-0.1 * kernel.squared_distances(z, z))
    beta = np.zeros(40)
    for _ in range(300):
        for i, j in itertools.combinations(range(40), 2):
            curve = k[i, i] + k[j, j] - 2 * k[i, j]
            if curve < 1e-12:
                continue
            slope = (b.y[i] - b.y[j]) - (k[i] - k[j]) @ beta  # of the smooth part along +i, -j
            options = [0.0]
            for si, sj in itertools.product((-1, 1), repeat=2):  # signs of the two in the end
                step = (slope - 0.1 * (si - sj)) / curve
                low = max(-1 - beta[i], beta[j] - 1, -beta[i] if si > 0 else -9, beta[j] if sj < 0 else -9)
                high = min(1 - beta[i], beta[j] + 1, -beta[i] if si < 0 else 9, beta[j] if sj > 0 else 9)
                options += [float(np.clip(step, low, high))] if low <= high else []
            gain = [t * slope - t * t * curve / 2 - 0.1 * (abs(beta[i] + t) + abs(beta[j] - t) - abs(beta[i]) - abs(beta[j])) for t in options]
            t = options[int(np.argmax(gain))]
            beta[i], beta[j] = beta[i] + t, beta[j] - t
    free = (np.abs(beta) > 1e-6) & (np.abs(beta) < 1 - 1e-6)
    bias = np.mean((b.y - k @ beta - 0.1 * np.sign(beta))[free])
    assert np.abs(k @ beta + bias - kernel.predict_svr(m, b.x)).max() < 0.02


def test_landmarks_bound_the_kernel_machine():
    """Fewer landmarks than rows: all rows still take part, and copies of a row take one landmark."""
    b = data(400)
    whole, some = (kernel.fit_svr(blocks.Held(b), 6, 1.0, 0.1, 0.05, most) for most in (1024, 120))
    assert len(whole["landmarks"]) == 400 and len(some["landmarks"]) == 120
    error = lambda m: np.mean((kernel.predict_svr(m, b.x) - b.y) ** 2) / b.y.var()
    assert error(some) < error(whole) + 0.1
    twice = blocks.Block(*(np.concatenate([v, v]) for v in (b.x, b.y, b.w, b.u)))
    assert len(kernel.fit_svr(blocks.Held(twice), 6)["landmarks"]) == 400


def test_linear_machine_is_stationary():
    b = data(120, classes=3)
    m = kernel.fit_linear_svc(blocks.Held(b), 6, 3, 0.5)
    z = np.concatenate([blocks.scaled(b.x, m["mean"], m["deviation"]), np.ones((120, 1))], axis=1)
    for label, v in enumerate(m["weights"]):
        t = np.where(b.y == label, 1.0, -1.0)
        slope = v - 2 * 0.5 * z.T @ (b.w * t * np.maximum(1 - t * (z @ v), 0))
        assert np.abs(slope).max() < 1e-5


# boosting


def brute_tree(x, g, h, p):
    """Best-first growth over raw values: leaves as (rows, value)."""
    score = lambda r: max(abs(g[r].sum()) - p.l1, 0) ** 2 / (h[r].sum() + p.l2)

    def best(rows, depth):
        found = (0.0, None, None)
        if p.depth is not None and depth >= p.depth:
            return found
        for j in range(x.shape[1]):
            v = x[rows, j]
            known = np.unique(v[~np.isnan(v)])
            for cut in [*(known[1:] + known[:-1]) / 2, np.inf]:
                for unknown_left in ((False, True) if np.isnan(v).any() else (False,)):
                    goes = np.where(np.isnan(v), unknown_left, v <= cut)
                    a, b = rows[goes], rows[~goes]
                    if min(len(a), len(b)) < p.least_rows or min(h[a].sum(), h[b].sum()) < p.least_hessian:
                        continue
                    gain = (score(a) + score(b) - score(rows)) / 2 - p.gamma
                    if gain > found[0] + 1e-9:
                        found = (gain, a, b)
        return found

    leaves = [(np.arange(len(x)), 0, best(np.arange(len(x)), 0))]
    while p.leaves is None or len(leaves) < p.leaves:
        i = max(range(len(leaves)), key=lambda k: leaves[k][2][0])
        gain, a, b = leaves[i][2]
        if gain <= 0:
            break
        depth = leaves[i][1] + 1
        leaves[i : i + 1] = [(a, depth, best(a, depth)), (b, depth, best(b, depth))]
    out = np.zeros(len(x))
    for rows, *_ in leaves:
        total = g[rows].sum()
        out[rows] = -p.rate * np.sign(total) * max(abs(total) - p.l1, 0) / (h[rows].sum() + p.l2)
    return out


GROWTHS = [
    boosting.Growth(rounds=4, rate=0.3, leaves=6, least_rows=8),
    boosting.Growth(rounds=3, rate=0.3, leaves=31, depth=3, least_rows=5, l2=0.5),
    boosting.Growth(rounds=3, rate=0.2, leaves=None, depth=4, least_rows=1, least_hessian=3.0, l2=2.0, l1=0.3, gamma=0.2),
]


@pytest.mark.parametrize("p", GROWTHS)
@pytest.mark.parametrize("unknown", [False, True])
def test_boosting_equals_brute_force(p, unknown):
    b = data(90, 5)
    if unknown:
        b.x[np.random.default_rng(1).random(b.x.shape) < 0.15] = np.nan
    m = boosting.fit(blocks.Held(blocks.Block(b.x, b.y, b.w, b.u)), p)
    f = np.full(90, (b.w @ b.y) / b.w.sum())
    for _ in range(p.rounds):
        f = f + brute_tree(b.x, b.w * (f - b.y), b.w, p)
    assert np.abs(boosting.predict(m, b.x) - f).max() < 1e-8


@pytest.mark.parametrize("p", GROWTHS[1:])
def test_boosting_of_classes_equals_brute_force(p):
    b = data(90, 4, classes=3)
    m = boosting.fit(blocks.Held(blocks.Block(b.x, b.y, b.w, b.u)), p, 3)
    f = np.tile(np.log(np.array([b.w[b.y == k].sum() for k in range(3)]) / b.w.sum()), (90, 1))
    for _ in range(p.rounds):
        e = np.exp(f - f.max(1, keepdims=True))
        q = e / e.sum(1, keepdims=True)
        f = f + np.stack([brute_tree(b.x, b.w * (q[:, k] - (b.y == k)), b.w * q[:, k] * (1 - q[:, k]), p) for k in range(3)], axis=1)
    assert np.abs(boosting.margins(m, b.x) - f).max() < 1e-8


def test_bins_of_many_values_hold_equal_shares():
    b = data(20_000, 6)
    borders = boosting.cuts(blocks.Held(b), 16)
    counts = np.bincount(boosting.binned(b.x, borders)[:, 0].astype(int))
    assert len(borders[0]) == 15 and counts.max() < 1.1 * 20_000 / 16


# extra trees


def one_tree(b, p, classes, number):
    """The same tree by recursion over its rows, predicting them."""
    out = np.zeros((len(b.y), max(classes, 1)))
    d = b.x.shape[1]

    def grow(rows, key, depth):
        t = extra_trees.targets(b.where(rows), classes)
        sums = t.sum(0)
        out[rows] = sums[1] / sums[0] if classes == 1 else sums[1:] / sums[0]
        own = extra_trees.impurity(sums, classes)
        low, high = b.x[rows].min(0), b.x[rows].max(0)
        if len(rows) < max(p.least_split, 2 * p.least_leaf) or own <= 1e-12 * max(sums[0], 1) or not (high > low).any() or (p.depth is not None and depth >= p.depth):
            return
        k = np.array([key], dtype=np.uint64)
        count = {"sqrt": max(1, int(np.sqrt(d)))}.get(p.features) or max(1, int(float(p.features) * d))
        order = np.argsort(np.where(high > low, extra_trees.drawn(k, d, 1)[0], 2.0), kind="stable")[:count]
        cuts = low + extra_trees.drawn(k, d, 2)[0] * (high - low)
        best = (-np.inf, None)
        for j in order:
            goes = b.x[rows, j] <= cuts[j]
            if high[j] > low[j] and min(goes.sum(), (~goes).sum()) >= max(p.least_leaf, 1):
                gain = own - extra_trees.impurity(t[goes].sum(0), classes) - extra_trees.impurity(t[~goes].sum(0), classes)
                if gain > best[0] + 1e-12:
                    best = (gain, goes)
        if best[1] is not None:
            with np.errstate(over="ignore"):
                left, right = (np.uint64(key) * np.uint64(0xD1342543DE82EF95) + np.uint64(c) for c in (1, 2))
            grow(rows[best[1]], left, depth + 1)
            grow(rows[~best[1]], right, depth + 1)

    with np.errstate(over="ignore"):
        grow(np.arange(len(b.y)), np.uint64(number) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(p.seed), 0)
    return out


@pytest.mark.parametrize(("classes", "p"), [(1, extra_trees.Forest(trees=7, depth=5, least_split=6, least_leaf=3, features=0.6, together=3)), (3, extra_trees.Forest(trees=5, least_leaf=2)), (1, extra_trees.Forest(trees=3))])
def test_extra_trees_equal_recursion(classes, p):
    b = data(100, 7, classes=classes if classes > 1 else 0)
    m = extra_trees.fit(blocks.Held(b), p, classes)
    want = sum(one_tree(b, p, classes, t) for t in range(p.trees)) / p.trees
    assert np.abs(extra_trees.scores(m, b.x) - want).max() < 1e-9


# perceptrons


@pytest.mark.parametrize("activation", ["relu", "tanh"])
@pytest.mark.parametrize("classes", [1, 3])
def test_gradients_are_numeric_ones(activation, classes):
    b = data(30, 5, classes=classes if classes > 1 else 0)
    weights = perceptron.started([5, 6, 4, classes], 1)
    _, _, *slopes = perceptron.gradient(b, weights, activation, classes)
    for w, slope in zip(weights, slopes):
        for at in itertools.islice(np.ndindex(w.shape), 0, None, 3):
            kept, values = w[at], []
            for step in (1e-6, -1e-6):
                w[at] = kept + step
                values.append(perceptron.gradient(b, weights, activation, classes)[1])
            w[at] = kept
            assert abs((values[0] - values[1]) / 2e-6 - slope[at]) < 1e-4 * max(1, abs(slope[at]))


def test_perceptrons_learn_and_stop_early():
    b, c = data(600), data(600, classes=3)
    p = perceptron.Net(rate=3e-3, hidden=(32, 16))
    r = perceptron.predict(perceptron.fit(blocks.Held(b), 6, p), b.x)
    assert 1 - np.mean((r - b.y) ** 2) / b.y.var() > 0.8
    assert np.mean(perceptron.predict(perceptron.fit(blocks.Held(c), 6, p, 3), c.x) == c.y) > 0.75


# one block or a table


SMALL = {
    "Boosting": {"rounds": 9, "least_rows": 8, "depth": 2},  # margins are written once in between
    "SecondOrder": {"rounds": 2, "depth": 3, "row_share": 0.8, "column_share": 0.7},
    "ExtraTrees": {"trees": 6, "depth": 3},
    "SVR": {"C": 0.3, "epsilon": 0.3},
    "LinearSVC": {},
    "Ridge": {},
    "Perceptron": {"epochs": 3, "hidden": (8,)},
}


@pytest.mark.parametrize(("task", "kind"), [*(("regression", k) for k in catalogue.REGRESSORS), *(("classification", k) for k in catalogue.CLASSIFIERS)])
def test_a_table_gives_the_model_of_one_block(spark, task, kind):
    b = data(120, 7, classes=3 if task != "regression" else 0)
    with scratch(spark):
        one, other = (catalogue.fit(r, task, kind, SMALL[kind], 4) for r in (blocks.Held(blocks.Block(b.x, b.y, b.w, b.u)), spread(spark, b)))
    a, c = (catalogue.predict(task, kind, catalogue.unpacked(catalogue.packed(m)), b.x) for m in (one, other))
    assert np.abs(a - c).max() < 1e-5 if task == "regression" else np.mean(a == c) > 0.98


# the search


@pytest.fixture(scope="module")
def full(spark, sf_dir):
    from furrow.operators.classes import add_classes

    return add_classes(lags.add_lags(panel.panel_view(spark, sf_dir))).cache()


def test_search_of_both_tasks(spark, full, monkeypatch):
    """With few rows held in groups, and with sums over the table: the same scores and choice."""
    names = ["aod", "pm", "yield_lag1", "yield_lag2"]
    options = {"kinds": ["Ridge"], "mode": "fast", "most": 2, "n_splits": 2, "feature_set": "full"}
    model, info, table = search.search(full, names, "regression", **options)
    one = sorted((r.position, r.fold, round(r.score, 6)) for r in table.collect())
    assert len(one) == 4 and len(info["tried"]) == 2 and info["oof"]["n"] == 50
    assert model.predict(full).where("yield_pred is null").count() == 0
    mean = {p: sum(s for q, _, s in one if q == p) / 2 for p in (0, 1)}
    assert info["cv"] == pytest.approx(max(mean.values()), abs=1e-5)
    monkeypatch.setattr(search, "HELD_BYTES", 0)
    assert sorted((r.position, r.fold, round(r.score, 6)) for r in search.search(full, names, "regression", **options)[2].collect()) == one
    monkeypatch.undo()
    options = {"kinds": ["LinearSVC"], "by_regression": ["Boosting"], "mode": "metrics", "most": 1, "n_splits": 2, "tertiles": "refit"}
    model, info, table = search.search(full, names, "classification", **options)
    assert {t["candidate"].split()[0] for t in info["tried"]} == {"LinearSVC", "Reg2Tertile"} and len(info["compared"]) == 3
    assert table.count() == 4 and 0 <= info["oof"]["f1_macro"] <= 1 and info["train"]["f1_macro"] > info["oof"]["f1_macro"]


def test_a_pipeline_of_stages_is_saved_and_loaded(spark, full, tmp_path):
    from furrow.operators.classes import to_class
    from furrow.operators.stages import LagInteractions, LagStatistics, PanelLearner, TargetMeans, TertileClasses
    from pyspark.ml import Pipeline, PipelineModel

    names, settings = ["aod", "pm", "yield_lag1"], {"rounds": 5, "least_rows": 10}
    stages = [LagStatistics(), TargetMeans(smoothing=3.0), LagInteractions(), PanelLearner(kind="Boosting", features=[*names, *search.derived_names()], settings=json.dumps(settings)), TertileClasses()]
    Pipeline(stages=stages).write().overwrite().save(str(tmp_path / "unfitted"))
    model = Pipeline.load(str(tmp_path / "unfitted")).fit(full)
    model.write().overwrite().save(str(tmp_path / "fitted"))
    show = lambda df: sorted((r.region, r.crop, r.year, round(r.yield_pred, 6), r.pred_class) for r in df.collect())
    one = show(model.transform(full))
    assert one == show(PipelineModel.load(str(tmp_path / "fitted")).transform(full)) and len(one) == full.count()
    same = search.fit(full, "Boosting", "regression", names, settings, smoothing=3.0)
    assert one == show(to_class(same.predict(full), full))


def test_a_candidate_that_fails_is_recorded(spark, full, monkeypatch):
    broken = catalogue.Kind(lambda *a: 1 / 0, None, {"k": [1]}, (1, 1, 1))
    monkeypatch.setitem(catalogue.REGRESSORS, "Broken", broken)
    monkeypatch.setattr(search, "HELD_BYTES", 0)  # on the driver, where the catalogue is patched
    _, info, _ = search.search(full, ["aod", "yield_lag1"], kinds=["Broken", "Ridge"], most=1, n_splits=2, feature_set="full")
    assert "ZeroDivisionError" in info["tried"][0]["error"] and info["kind"] == "Ridge"


def test_forty_fits_leave_the_heap_as_it_is(spark, full):
    def used() -> float:
        gc.collect()
        for _ in range(3):
            spark._jvm.System.gc()
            time.sleep(0.2)
        runtime = spark._jvm.java.lang.Runtime.getRuntime()
        return (runtime.totalMemory() - runtime.freeMemory()) / 1e6

    def fits(n: int) -> None:
        for k in range(n):
            with scratch(spark):
                search.fit(full, "Ridge", "regression", ["aod", "yield_lag1"], {"alpha": 1.0 + k}).predict(full).count()

    fits(5)
    before = used()
    fits(40)
    assert used() - before < 120

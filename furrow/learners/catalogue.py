"""The learners by name, with their search spaces."""

from __future__ import annotations

import io
import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from furrow.learners import boosting, extra_trees, kernel, perceptron
from furrow.learners.blocks import Block, Held, Spread

#: How many candidates of each kind a search tries, by mode.
MODES = ("fast", "metrics", "full")


@dataclass(frozen=True)
class Kind:
    """``fit(rows, numeric, classes, params, seed)`` gives arrays that ``predict(arrays, x)`` takes; classes is 1 in regressions."""

    fit: Callable[..., dict[str, np.ndarray]]
    predict: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]
    space: dict[str, list]
    tries: tuple[int, int, int]


def _boosting(rows, numeric, classes, params, seed):
    return boosting.fit(rows, boosting.Growth(**{"seed": seed, **params}), classes)


def _second_order(rows, numeric, classes, params, seed):
    given = {"rounds": 1600 if classes == 1 else 1200, "leaves": None, "least_rows": 1, "l2": 1.0, "least_hessian": 1.0, "depth": 6, "rate": 0.3, "seed": seed}
    return boosting.fit(rows, boosting.Growth(**{**given, **params}), classes)


def _extra_trees(rows, numeric, classes, params, seed):
    return extra_trees.fit(rows, extra_trees.Forest(**{"seed": seed, **params}), classes)


def _perceptron(rows, numeric, classes, params, seed):
    given = {"epochs": 2000, "patience": 25} if classes == 1 else {"epochs": 1200, "patience": 20}
    return perceptron.fit(rows, numeric, perceptron.Net(**{"seed": seed, **given, **params, "hidden": tuple(params.get("hidden", (64,)))}), classes)


def _svr(rows, numeric, classes, params, seed):
    return kernel.fit_svr(rows, numeric, **params)


def _ridge(rows, numeric, classes, params, seed):
    return kernel.fit_ridge(rows, numeric, **params)


def _linear_svc(rows, numeric, classes, params, seed):
    return kernel.fit_linear_svc(rows, numeric, classes, **params)


#: The search spaces; candidates are drawn from their cells.
REGRESSORS = {
    "Boosting": Kind(_boosting, boosting.predict, {
        "rate": [0.01, 0.02, 0.03, 0.05],
        "depth": [2, 3, 4],
        "leaves": [15, 31, 63],
        "least_rows": [10, 20, 30, 40, 60],
        "l2": [0.0, 0.01, 0.05, 0.1, 0.3],
    }, (16, 30, 55)),
    "Perceptron": Kind(_perceptron, perceptron.predict, {
        "hidden": [(64,), (128,), (64, 32), (128, 64), (256, 128)],
        "activation": ["relu", "tanh"],
        "alpha": [1e-6, 1e-5, 1e-4, 1e-3, 1e-2],
        "rate": [1e-4, 3e-4, 1e-3, 3e-3],
        "batch": [32, 64, 128],
    }, (6, 16, 30)),
    "SecondOrder": Kind(_second_order, boosting.predict, {
        "depth": [2, 3, 4, 5, 6],
        "rate": [0.005, 0.01, 0.02, 0.03],
        "row_share": [0.6, 0.75, 0.9, 0.98],
        "column_share": [0.5, 0.65, 0.8, 0.95],
        "least_hessian": [1, 3, 5, 10, 15, 25],
        "gamma": [0.0, 0.1, 0.2, 0.5, 1.0],
        "l2": [0.5, 1.0, 3.0, 5.0, 10.0, 20.0, 50.0],
        "l1": [0.0, 0.1, 0.3, 0.5, 1.0],
    }, (0, 40, 85)),
    "ExtraTrees": Kind(_extra_trees, extra_trees.predict, {
        "trees": [600, 1200],
        "depth": [6, 8, None],
        "least_split": [10, 20, 30],
        "least_leaf": [5, 10, 20],
        "features": ["sqrt", 0.6, 0.8],
    }, (0, 0, 35)),
    "SVR": Kind(_svr, kernel.predict_svr, {
        "C": [0.3, 1.0, 3.0, 10.0],
        "gamma": ["scale", "auto"],
        "epsilon": [0.03, 0.05, 0.1, 0.2],
    }, (0, 0, 16)),
    "Ridge": Kind(_ridge, kernel.predict_ridge, {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]}, (5, 5, 5)),
}
CLASSIFIERS = {
    "Boosting": Kind(_boosting, boosting.predict, {
        "rate": [0.02, 0.03, 0.05],
        "depth": [2, 3, 4],
        "leaves": [15, 31, 63],
        "least_rows": [20, 30, 40, 60],
        "l2": [0.01, 0.05, 0.1, 0.3],
    }, (12, 22, 45)),
    "ExtraTrees": Kind(_extra_trees, extra_trees.predict, {
        "trees": [600, 1200],
        "depth": [6, 8, None],
        "least_split": [10, 20, 30],
        "least_leaf": [5, 10, 20],
        "features": ["sqrt", 0.6, 0.8],
    }, (10, 18, 35)),
    "LinearSVC": Kind(_linear_svc, kernel.predict_linear_svc, {"C": [0.01, 0.03, 0.05, 0.1, 0.3, 1.0, 3.0]}, (0, 10, 14)),
    "Perceptron": Kind(_perceptron, perceptron.predict, {
        "hidden": [(64,), (128,), (64, 32), (128, 64)],
        "activation": ["relu", "tanh"],
        "alpha": [1e-5, 1e-4, 1e-3, 1e-2],
        "rate": [1e-4, 3e-4, 1e-3, 3e-3],
        "batch": [32, 64, 128],
    }, (6, 14, 26)),
    "SecondOrder": Kind(_second_order, boosting.predict, {
        "depth": [2, 3, 4, 5],
        "rate": [0.01, 0.02, 0.03],
        "row_share": [0.65, 0.8, 0.95],
        "column_share": [0.5, 0.65, 0.8, 0.95],
        "least_hessian": [3, 5, 10, 15, 25],
        "gamma": [0.0, 0.2, 0.5, 1.0],
        "l2": [1.0, 5.0, 10.0, 20.0, 50.0],
        "l1": [0.0, 0.1, 0.5, 1.0],
    }, (0, 26, 60)),
}
#: The regressors whose predictions are also turned into classes.
BY_REGRESSION = ("Boosting", "SecondOrder", "Perceptron")


@dataclass(frozen=True)
class Candidate:
    kind: str
    params: tuple[tuple[str, object], ...]

    def __str__(self) -> str:
        return f"{self.kind} {json.dumps(dict(self.params))}"


def candidates(kinds: dict[str, Kind], names, mode: str, seed: int, most: int | None = None) -> list[Candidate]:
    """A seeded sample of each space's cells, as many as the mode says (``most`` at most), or all if there are fewer."""
    out, rng = [], random.Random(seed)
    for name in names:
        space = kinds[name].space
        cells = math.prod(map(len, space.values()))
        n = min(kinds[name].tries[MODES.index(mode)], cells if most is None else min(most, cells))
        for cell in sorted(rng.sample(range(cells), n)):
            params = []
            for key, values in reversed(space.items()):
                cell, at = divmod(cell, len(values))
                params.append((key, values[at]))
            out.append(Candidate(name, tuple(reversed(params))))
    return out


def _counts(b: Block, classes: int):
    return (np.bincount(b.y.astype(int), minlength=classes).astype(float),)


def fit(rows: Held | Spread, task: str, kind: str, params: dict, numeric: int, seed: int = 42, power: float = 1.0, classes: int = 3) -> dict[str, np.ndarray]:
    """Arrays of a fitted model; the classes of a classification are weighted by (n / (k n_class)) ** power."""
    if task == "regression":
        return REGRESSORS[kind].fit(rows, numeric, 1, params, seed)
    (n,) = rows.sum(_counts, classes)
    weight = np.where(n > 0, (n.sum() / ((n > 0).sum() * np.maximum(n, 1))) ** power, 0.0)
    return CLASSIFIERS[kind].fit(rows.weighted(weight), numeric, classes, params, seed)


def predict(task: str, kind: str, arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return (REGRESSORS if task == "regression" else CLASSIFIERS)[kind].predict(arrays, x)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}

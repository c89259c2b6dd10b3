"""Support vectors with a radial kernel, and linear ones with the squared hinge, by Newton steps on sums.

The kernel machine works on landmarks: the distinct training rows, or where there are more than
``most`` a fixed sample of that many (a documented bound of the fit; every row takes part in it).
With K the kernel among landmarks, rows become z = k(x) K^(-1/2), so that for landmarks that are all
rows the machine is the exact one. It minimises

    |v|^2 / 2 + C * sum of w * max(0, |y - v.z - b| - epsilon)

by Newton steps on a smoothed loss, quadratic over a width that shrinks from step to step until it
is far below epsilon. Each step needs one pass: the gradient and the m x m Hessian are sums over rows.
A row's multiplier follows from its residual, so that no pass keeps anything by row. The rows with a
multiplier that isn't 0 are the support set."""

from __future__ import annotations

import numpy as np

from furrow.learners.blocks import Block, Held, Spread, moments, scaled, shares

LANDMARKS = 1024


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _landmarks(b: Block, most: int):
    return _least((b.x, shares(b.u, 17)), (b.x[:0], np.zeros(0)), most)


def _least(a, b, most: int):
    """The ``most`` distinct rows of least number."""
    x, s = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(s, kind="stable")
    x, s = x[order], s[order]
    kept = np.sort(np.unique(x, axis=0, return_index=True)[1])[:most]
    return x[kept], s[kept]


def _variance(b: Block):
    return np.float64(b.x.size), b.x.sum(), (b.x * b.x).sum()


def features(x: np.ndarray, mean, deviation, landmarks: np.ndarray, gamma: float, root: np.ndarray) -> np.ndarray:
    return np.exp(-gamma * squared_distances(scaled(x, mean, deviation), landmarks)) @ root


def _smooth(b: Block, v: np.ndarray, epsilon: float, width: float):
    """Loss, gradient and Hessian (bias last) of the smoothed loss over the rows."""
    z = np.concatenate([b.x, np.ones((len(b.y), 1))], axis=1)
    r = b.y - z @ v
    over = np.abs(r) - epsilon
    part = np.clip(over / width, 0, 1)
    loss = np.where(over <= 0, 0, np.where(over <= width, over**2 / (2 * width), over - width / 2))
    inner = b.w * ((over > 0) & (over < width)) / width
    return b.w @ loss, -z.T @ (b.w * part * np.sign(r)), (z * inner[:, None]).T @ z


def _losses(b: Block, tries: np.ndarray, epsilon: float, width: float):
    z = np.concatenate([b.x, np.ones((len(b.y), 1))], axis=1)
    over = np.abs(b.y[:, None] - z @ tries.T) - epsilon
    return (b.w @ np.where(over <= 0, 0, np.where(over <= width, over**2 / (2 * width), over - width / 2)),)


STEPS = 0.5 ** np.arange(24)


def newton(rows: Held | Spread, start: np.ndarray, penalty: np.ndarray, loss, losses, args: tuple, most: int = 200) -> np.ndarray:
    """Minimise penalty.v^2 / 2 + the loss; the longest of ``STEPS`` that lowers the objective is taken.
    All steps are tried in the one pass that also judges them."""
    v = start
    for _ in range(most):
        value, slope, curve = rows.sum(loss, v, *args)
        value += penalty @ (v * v) / 2
        slope = slope + penalty * v
        way = -np.linalg.solve(curve + np.diag(penalty) + 1e-10 * np.eye(len(v)), slope)
        fall = -(slope @ way)
        if fall <= 1e-12 * max(1.0, abs(value)):
            break
        tries = v + STEPS[:, None] * way
        (found,) = rows.sum(losses, tries, *args)
        found = found + (tries * tries) @ penalty / 2
        good = np.flatnonzero(found <= value - 1e-4 * STEPS * fall)
        if not len(good):
            break
        v = tries[good[0]]
    return v


def fit_svr(rows: Held | Spread, numeric: int, C: float = 1.0, epsilon: float = 0.1, gamma: float | str = "scale", most: int = LANDMARKS) -> dict[str, np.ndarray]:
    """``numeric``: the first features, which are scaled."""
    mean, deviation = moments(rows, numeric)
    wide = rows.mapped(scaled, mean, deviation)
    n, s, q = wide.sum(_variance)
    width = int(wide.sum(_columns, merge=first)[0])
    spread = q / n - (s / n) ** 2
    gamma = float({"scale": 1 / (width * spread) if spread > 0 else 1.0, "auto": 1 / width}.get(gamma, gamma))
    landmarks, _ = wide.sum(_landmarks, most, merge=lambda a, b: _least(a, b, most))
    wide.done()
    value, vector = np.linalg.eigh(np.exp(-gamma * squared_distances(landmarks, landmarks)))
    kept = value > value[-1] * 1e-12
    root = vector[:, kept] / np.sqrt(value[kept])
    mapped = rows.mapped(features, mean, deviation, landmarks, gamma, root)
    total, mass = mapped.sum(_target)
    v = np.zeros(kept.sum() + 1)
    v[-1] = total / mass
    penalty = np.append(np.full(kept.sum(), 1 / C), 0.0)
    for width in max(epsilon, 1e-3) * 10.0 ** np.arange(1.5, -4.5, -0.5):
        v = newton(mapped, v, penalty, _smooth, _losses, (epsilon, width))
    (n_support,) = mapped.sum(_supported, v, epsilon, width)
    mapped.done()
    return {"mean": mean, "deviation": deviation, "landmarks": landmarks, "gamma": np.float64(gamma), "weights": root @ v[:-1], "bias": np.float64(v[-1]), "epsilon": np.float64(epsilon), "width": np.float64(width), "C": np.float64(C), "n_support": np.int64(n_support)}


def first(a, b):
    return a


def _columns(b: Block):
    return (np.int64(b.x.shape[1]),)


def _target(b: Block):
    return b.w @ b.y, b.w.sum()


def _supported(b: Block, v: np.ndarray, epsilon: float, width: float):
    return (np.int64((np.abs(b.y - b.x @ v[:-1] - v[-1]) > epsilon).sum()),)


def predict_svr(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.exp(-m["gamma"] * squared_distances(scaled(x, m["mean"], m["deviation"]), m["landmarks"])) @ m["weights"] + m["bias"]


def multipliers(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each row's multiplier, from -C to C: 0 inside the tube, what a row lends to the solution outside."""
    r = y - predict_svr(m, x)
    return m["C"] * np.clip((np.abs(r) - m["epsilon"]) / m["width"], 0, 1) * np.sign(r)


# linear, squared hinge, one class against the rest


def _hinge(b: Block, v: np.ndarray, label: int):
    z = np.concatenate([b.x, np.ones((len(b.y), 1))], axis=1)
    t = np.where(b.y == label, 1.0, -1.0)
    gap = np.maximum(1 - t * (z @ v), 0)
    some = b.w * (gap > 0)
    return b.w @ gap**2, -2 * z.T @ (b.w * t * gap), 2 * (z * some[:, None]).T @ z


def _hinges(b: Block, tries: np.ndarray, label: int):
    z = np.concatenate([b.x, np.ones((len(b.y), 1))], axis=1)
    t = np.where(b.y == label, 1.0, -1.0)
    return (b.w @ np.maximum(1 - t[:, None] * (z @ tries.T), 0) ** 2,)


def fit_linear_svc(rows: Held | Spread, numeric: int, classes: int = 3, C: float = 1.0) -> dict[str, np.ndarray]:
    """|v|^2 / 2 + C * squared hinge for each class against the rest; the bias is penalised like a weight."""
    mean, deviation = moments(rows, numeric)
    wide = rows.mapped(scaled, mean, deviation)
    d = int(wide.sum(_columns, merge=first)[0])
    weights = [newton(wide, np.zeros(d + 1), np.full(d + 1, 1 / C), _hinge, _hinges, (k,)) for k in range(classes)]
    wide.done()
    return {"mean": mean, "deviation": deviation, "weights": np.array(weights)}


def predict_linear_svc(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = scaled(x, m["mean"], m["deviation"])
    return (z @ m["weights"][:, :-1].T + m["weights"][:, -1]).argmax(1)


# ridge


def _gram(b: Block):
    z = np.concatenate([b.x, np.ones((len(b.y), 1))], axis=1)
    return (z * b.w[:, None]).T @ z, z.T @ (b.w * b.y)


def fit_ridge(rows: Held | Spread, numeric: int, alpha: float = 1.0) -> dict[str, np.ndarray]:
    """Least squares with alpha * |v|^2, the bias free: one pass."""
    mean, deviation = moments(rows, numeric)
    wide = rows.mapped(scaled, mean, deviation)
    gram, target = wide.sum(_gram)
    wide.done()
    v = np.linalg.lstsq(gram + np.diag(np.append(np.full(len(gram) - 1, alpha), 0.0)), target, rcond=None)[0]
    return {"mean": mean, "deviation": deviation, "weights": v}


def predict_ridge(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return scaled(x, m["mean"], m["deviation"]) @ m["weights"][:-1] + m["weights"][-1]

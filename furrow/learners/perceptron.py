"""Perceptrons with hidden layers: back-propagation over batches, Adam, L2 and early stopping.

Each step is the sum of gradients over one batch; batches are shares of the rows by their own
numbers, another cut in each epoch, and there are at most ``steps`` an epoch however long the table
is. A share of the rows is held out; training ends when their score hasn't grown for a while, and the
best weights stay. Features and target are scaled to deviation 1."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from furrow.learners.blocks import Block, Held, Spread, moments, scaled, shares


@dataclass(frozen=True)
class Net:
    hidden: tuple[int, ...] = (64,)
    activation: str = "relu"
    alpha: float = 1e-4
    rate: float = 1e-3
    batch: int = 64
    epochs: int = 2000
    patience: int = 25
    least_gain: float = 1e-4
    held_out: float = 0.15
    steps: int = 32
    seed: int = 42


def started(sizes: list[int], seed: int) -> list[np.ndarray]:
    """Weights and biases, layer by layer."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt(6 / (a + b))
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    return out


def forward(x: np.ndarray, weights: list[np.ndarray], activation: str) -> list[np.ndarray]:
    layers = [x]
    for i in range(0, len(weights), 2):
        z = layers[-1] @ weights[i] + weights[i + 1]
        layers.append(z if i == len(weights) - 2 else np.tanh(z) if activation == "tanh" else np.maximum(z, 0))
    return layers


def _error(out: np.ndarray, y: np.ndarray, classes: int):
    """(loss, its slope at the output) of each row."""
    if classes == 1:
        return (out[:, 0] - y) ** 2 / 2, out - y[:, None]
    e = np.exp(out - out.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    own = y.astype(int)
    slope = p.copy()
    slope[np.arange(len(y)), own] -= 1
    return -np.log(np.maximum(p[np.arange(len(y)), own], 1e-300)), slope


def gradient(b: Block, weights: list[np.ndarray], activation: str, classes: int):
    """(weight of the rows, loss, gradient of each array), summed over the rows."""
    layers = forward(b.x, weights, activation)
    loss, slope = _error(layers[-1], b.y, classes)
    slope = slope * b.w[:, None]
    out: list[np.ndarray] = []
    for i in range(len(weights) - 2, -1, -2):
        inner = layers[i // 2]
        out = [inner.T @ slope, slope.sum(0), *out]
        if i:
            slope = slope @ weights[i].T
            slope = slope * (1 - inner**2 if activation == "tanh" else inner > 0)
    return (b.w.sum(), b.w @ loss, *out)


def _step(b: Block, weights, activation: str, classes: int, held_out: float, seed: int, salt: int, low: float, high: float):
    s = shares(b.u, salt)
    return gradient(b.where((s >= low) & (s < high) & (shares(b.u, seed) >= held_out)), weights, activation, classes)


def _score(b: Block, weights, activation: str, classes: int, held_out: float, seed: int):
    """Sums for the score of the held-out rows: (weight, squared error or hits, y, y * y)."""
    b = b.where(shares(b.u, seed) < held_out)
    out = forward(b.x, weights, activation)[-1]
    good = (out[:, 0] - b.y) ** 2 if classes == 1 else out.argmax(1) == b.y
    return b.w.sum(), b.w @ good, b.w @ b.y, b.w @ (b.y * b.y)


def _size(b: Block):
    return np.float64(len(b.y)), b.w.sum(), b.w @ b.y, b.w @ (b.y * b.y)


def _width(b: Block):
    return (np.int64(b.x.shape[1]),)


def first(a, b):
    return a


def _standard(b: Block, f, *state):
    return f(Block(b.x, (b.y - state[-2]) / state[-1], b.w, b.u), *state[:-2])


def fit(rows: Held | Spread, numeric: int, p: Net, classes: int = 1) -> dict[str, np.ndarray]:
    mean, deviation = moments(rows, numeric)
    wide = rows.mapped(scaled, mean, deviation)
    d = int(wide.sum(_width, merge=first)[0])
    n, w, s, q = wide.sum(_size)
    centre, spread = (s / w, np.sqrt(max(q / w - (s / w) ** 2, 0)) or 1.0) if classes == 1 else (0.0, 1.0)
    weights = started([d, *p.hidden, classes], p.seed)
    speed, square = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    best, since, t = (-np.inf, weights), 0, 0
    batches = int(np.clip(np.ceil(n * (1 - p.held_out) / p.batch), 1, p.steps))
    for epoch in range(p.epochs):
        for k in range(batches):
            got = wide.sum(_standard, _step, weights, p.activation, classes, p.held_out, p.seed, p.seed + 1 + epoch, k / batches, (k + 1) / batches, centre, spread)
            mass, _, *slope = got
            if mass <= 0:
                continue
            t += 1
            for i, g in enumerate(slope):
                g = (g + p.alpha * weights[i]) / mass if i % 2 == 0 else g / mass
                speed[i], square[i] = 0.9 * speed[i] + 0.1 * g, 0.999 * square[i] + 0.001 * g * g
                weights[i] = weights[i] - p.rate * (speed[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
        mass, good, s, q = wide.sum(_standard, _score, weights, p.activation, classes, p.held_out, p.seed, centre, spread)
        total = q - s * s / mass if mass > 0 else 0.0
        score = (good / mass if classes > 1 else 1 - good / total) if mass > 0 and (classes > 1 or total > 0) else 0.0
        if score > best[0] + p.least_gain:
            since = 0
        else:
            since += 1
        if score > best[0]:
            best = score, [x.copy() for x in weights]
        if since > p.patience:
            break
    wide.done()
    return {"mean": mean, "deviation": deviation, "centre": np.float64(centre), "spread": np.float64(spread), "tanh": np.bool_(p.activation == "tanh"), **{f"w{i}": x for i, x in enumerate(best[1])}}


def predict(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    weights = [m[f"w{i}"] for i in range(sum(k[0] == "w" for k in m))]
    out = forward(scaled(x, m["mean"], m["deviation"]), weights, "tanh" if m["tanh"] else "relu")[-1]
    return out[:, 0] * m["spread"] + m["centre"] if out.shape[1] == 1 else out.argmax(1)

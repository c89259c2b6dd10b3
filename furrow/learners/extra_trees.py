"""Extremely randomised trees: a random cut of each chosen feature between a node's least and largest value.

All rows train each tree. Trees grow level by level, ``together`` of them at once, with two passes a level:
one for the least and largest value of each feature in each open node, one for the sums on the left
of each node's random cuts. Features and cuts follow from the seed, the tree and the node alone, so
that the passes' results are all that is needed to go on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from furrow.learners.blocks import Block, Held, Spread, shares


@dataclass(frozen=True)
class Forest:
    trees: int = 600
    depth: int | None = None
    least_split: int = 2
    least_leaf: int = 1
    features: str | float = "sqrt"
    seed: int = 42
    together: int = 64


def targets(b: Block, classes: int) -> np.ndarray:
    """Columns whose sums tell a node's value and impurity, the weight first."""
    if classes == 1:
        return np.stack([b.w, b.w * b.y, b.w * b.y * b.y], axis=1)
    return np.concatenate([b.w[:, None], b.w[:, None] * (b.y[:, None] == np.arange(classes))], axis=1)


def routed(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, roots: int) -> np.ndarray:
    """The node of each row in each of the ``roots`` trees."""
    node = np.tile(np.arange(roots), (len(x), 1))
    row = np.broadcast_to(np.arange(len(x))[:, None], node.shape)
    going = feature[node] >= 0
    while going.any():
        at = node[going]
        node[going] = left[at] + (x[row[going], feature[at]] > cut[at])
        going = feature[node] >= 0
    return node


def _sorted(b: Block, tree, open_: np.ndarray, roots: int):
    """Rows of open nodes, ordered by node: (rows, number of their open node, where nodes start, which have rows)."""
    slot = np.full(len(tree[0]), -1)
    slot[open_] = np.arange(len(open_))
    place = slot[routed(b.x, *tree, roots)].reshape(-1)
    row = np.repeat(np.arange(len(b.y)), roots)
    some = np.flatnonzero(place >= 0)
    some = some[np.argsort(place[some], kind="stable")]
    present, start = np.unique(place[some], return_index=True)
    return row[some], place[some], start, present


def ranges(b: Block, tree, open_: np.ndarray, roots: int, classes: int):
    """(rows, sums of targets, least, largest value by feature) of each open node."""
    row, _, start, present = _sorted(b, tree, open_, roots)
    d = b.x.shape[1]
    n, low, high = np.zeros(len(open_)), np.full((len(open_), d), np.inf), np.full((len(open_), d), -np.inf)
    t = targets(b, classes)
    sums = np.zeros((len(open_), t.shape[1]))
    if len(row):
        n[present] = np.diff(np.append(start, len(row)))
        sums[present] = np.add.reduceat(t[row], start)
        low[present], high[present] = np.minimum.reduceat(b.x[row], start), np.maximum.reduceat(b.x[row], start)
    return n, sums, low, high


def _wider(a, b):
    return a[0] + b[0], a[1] + b[1], np.minimum(a[2], b[2]), np.maximum(a[3], b[3])


def lefts(b: Block, tree, open_: np.ndarray, roots: int, classes: int, feature: np.ndarray, cut: np.ndarray):
    """(rows, sums of targets) on the left of each node's cuts, of which node k has ``feature[k]`` and ``cut[k]``."""
    row, node, start, present = _sorted(b, tree, open_, roots)
    t = targets(b, classes)
    n, sums = np.zeros(feature.shape), np.zeros((*feature.shape, t.shape[1]))
    if len(row):
        under = b.x[row[:, None], feature[node]] <= cut[node]
        n[present] = np.add.reduceat(under.astype(float), start)
        for k in range(t.shape[1]):
            sums[present, :, k] = np.add.reduceat(under * t[row, k][:, None], start)
    return n, sums


def impurity(sums: np.ndarray, classes: int) -> np.ndarray:
    """The weighted variance or Gini impurity, times the weight."""
    w = np.maximum(sums[..., 0], 1e-300)
    if classes == 1:
        return np.maximum(sums[..., 2] - sums[..., 1] ** 2 / w, 0)
    return sums[..., 0] - (sums[..., 1:] ** 2).sum(-1) / w


def drawn(key: np.ndarray, columns: int, salt: int) -> np.ndarray:
    """Numbers in [0, 1) of each key and column."""
    return np.stack([shares(key, salt + 2 * j) for j in range(columns)], axis=1)


def fit(rows: Held | Spread, p: Forest, classes: int = 1) -> dict[str, np.ndarray]:
    parts = [_grown(rows, p, classes, np.arange(a, min(a + p.together, p.trees))) for a in range(0, p.trees, p.together)]
    at = np.cumsum([0, *(len(x[0]) for x in parts)])
    feature, cut, left, value = (np.concatenate(x) for x in zip(*parts))
    return {"feature": feature, "cut": cut, "left": left, "value": value, "at": at, "roots": np.array([min(p.together, p.trees - a) for a in range(0, p.trees, p.together)])}


def _grown(rows: Held | Spread, p: Forest, classes: int, numbers: np.ndarray):
    """(feature, cut, left child, value) of the nodes of some trees; the roots come first."""
    roots = len(numbers)
    feature, cut, left = np.full(roots, -1), np.zeros(roots), np.full(roots, -1)
    value = np.zeros((roots, max(classes, 1)))
    key = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(p.seed)
    open_, depth = np.arange(roots), 0
    while len(open_):
        tree = (feature, cut, left)
        n, sums, low, high = rows.sum(ranges, tree, open_, roots, classes, merge=_wider)
        value[open_] = sums[:, 1:2] / sums[:, :1] if classes == 1 else sums[:, 1:] / sums[:, :1]
        own = impurity(sums, classes)
        grow = (n >= max(p.least_split, 2 * p.least_leaf)) & (own > 1e-12 * np.maximum(sums[:, 0], 1)) & (high > low).any(1)
        if p.depth is not None and depth >= p.depth:
            grow[:] = False
        if not grow.any():
            break
        open_, sums, low, high, n, own = open_[grow], sums[grow], low[grow], high[grow], n[grow], own[grow]
        d = low.shape[1]
        count = {"sqrt": max(1, int(np.sqrt(d)))}.get(p.features) or max(1, int(float(p.features) * d))
        order = np.argsort(np.where(high > low, drawn(key[open_], d, 1), 2.0), axis=1, kind="stable")[:, :count]
        pick = lambda a: np.take_along_axis(a, order, 1)
        cuts = pick(low) + pick(drawn(key[open_], d, 2)) * (pick(high) - pick(low))
        n_left, s_left = rows.sum(lefts, tree, open_, roots, classes, order, cuts)
        gain = own[:, None] - impurity(s_left, classes) - impurity(sums[:, None] - s_left, classes)
        fit_ = (np.minimum(n_left, n[:, None] - n_left) >= max(p.least_leaf, 1)) & (pick(high) > pick(low))
        gain = np.where(fit_, gain, -np.inf)
        best = gain.argmax(1)
        split = gain[np.arange(len(best)), best] > -np.inf
        at = open_[split]
        first = len(feature) + 2 * np.arange(len(at))
        feature[at], cut[at], left[at] = order[split, best[split]], cuts[split, best[split]], first
        more = 2 * len(at)
        feature, cut, left = np.append(feature, np.full(more, -1)), np.append(cut, np.zeros(more)), np.append(left, np.full(more, -1))
        value = np.concatenate([value, np.zeros((more, value.shape[1]))])
        child = np.repeat(key[at], 2) * np.uint64(0xD1342543DE82EF95) + np.tile(np.array([1, 2], dtype=np.uint64), len(at))
        key = np.append(key, child)
        open_, depth = np.arange(len(feature) - more, len(feature)), depth + 1
    return feature, cut, left, value


def scores(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean value, or mean class shares, over the trees."""
    out = np.zeros((len(x), m["value"].shape[1]))
    for a, b, roots in zip(m["at"], m["at"][1:], m["roots"]):
        node = routed(x, m["feature"][a:b], m["cut"][a:b], m["left"][a:b], int(roots))
        out += m["value"][a:b][node].sum(1)
    return out / m["roots"].sum()


def predict(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    out = scores(m, x)
    return out[:, 0] if out.shape[1] == 1 else out.argmax(1)

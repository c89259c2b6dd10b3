"""Gradient boosting on binned features: histograms of gradients, best-first or level-wise growth.

Features are cut into at most ``bins`` ranges, once, at quantiles of a mergeable summary (exact where a
feature has no more distinct values than bins); unknown values have a bin of their own, which each
split sends to the side that gains more. One pass sums the gradients and Hessians of all leaves
whose split is not known yet, of all classes' trees at once. Of two siblings only the one with fewer
rows is summed: the other is what their parent has more. A leaf's split depends on its own sums alone,
so the best-first order (``max_leaves``) is found without a pass a leaf: each pass serves all leaves
that may still be split, and there are as many passes as the tree is deep.

Rows keep their margins: ``blocks.Spread`` writes them again every few trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from furrow.learners.blocks import Block, Held, Spread

SUMMARY = 4096


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``row_share`` and ``column_share`` are drawn anew for each tree."""

    rounds: int = 100
    rate: float = 0.1
    depth: int | None = None
    leaves: int | None = 31
    least_rows: int = 20
    least_hessian: float = 1e-3
    l2: float = 0.0
    l1: float = 0.0
    gamma: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = 255
    seed: int = 42


# bins


def _summary(b: Block):
    return tuple(_weighted(c[~np.isnan(c)]) for c in b.x.T)


def _weighted(values: np.ndarray, counts: np.ndarray | None = None):
    v, back = np.unique(values, return_inverse=True)
    n = np.bincount(back, counts, len(v)) if len(v) else np.zeros(0)
    return _shortened(v, n)


def _shortened(v: np.ndarray, n: np.ndarray):
    """At most SUMMARY values: where there are more, neighbours of equal mass become one, the first of them."""
    if len(v) <= SUMMARY:
        return v, n
    group = np.minimum((np.cumsum(n) - n) * SUMMARY // n.sum(), SUMMARY - 1).astype(np.int64)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return v[first], np.add.reduceat(n, first)


def _merged(a, b):
    return tuple(_weighted(np.concatenate([p[0], q[0]]), np.concatenate([p[1], q[1]])) for p, q in zip(a, b))


def cuts(rows: Held | Spread, bins: int) -> list[np.ndarray]:
    """Ascending borders of each feature; a value belongs to the first border that isn't below it."""
    out = []
    for v, n in rows.sum(_summary, merge=_merged):
        at = np.arange(len(v) - 1)
        if len(v) > bins:
            at = np.unique(np.minimum(np.searchsorted(np.cumsum(n), np.arange(1, bins) / bins * n.sum()), len(v) - 2))
        out.append((v[at] + v[at + 1]) / 2)
    return out


def binned(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """Bin numbers as doubles, so that blocks keep their form; unknown values have -1."""
    out = np.empty(x.shape)
    for j, c in enumerate(borders):
        out[:, j] = np.searchsorted(c, x[:, j], "left")
    out[np.isnan(x)] = -1
    return out


# trees


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. Rows with bin <= border go left, unknown ones to ``unknown_left``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    border: list[int] = field(default_factory=lambda: [0])
    unknown_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, border: int, unknown_left: bool) -> int:
        """The left child; the right one is next to it."""
        at = len(self.feature)
        self.feature[node], self.border[node], self.unknown_left[node], self.left[node] = feature, border, unknown_left, at
        for name, start in (("feature", -1), ("border", 0), ("unknown_left", False), ("left", -1), ("value", 0.0)):
            getattr(self, name).extend([start, start])
        return at

    def arrays(self) -> np.ndarray:
        return np.array([self.feature, self.border, self.unknown_left, self.left, self.value])


def routed(x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The leaf of each row of bins."""
    node = np.zeros(len(x), dtype=np.int64)
    feature, border, unknown_left, left = (tree[i].astype(np.int64) for i in range(4))
    going = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, dtype=np.int64)
    while len(going):
        at = node[going]
        v = x[going, feature[at]]
        right = np.where(v < 0, unknown_left[at] == 0, v > border[at])
        node[going] = left[at] + right
        going = going[feature[node[going]] >= 0]
    return node


def stepped(x: np.ndarray, trees: list[np.ndarray]) -> np.ndarray:
    """What one round adds to the margins."""
    return np.stack([t[4][routed(x, t)] for t in trees], axis=1)


def gradients(b: Block, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and class, times the row's weight."""
    if loss == "squared":
        g, h = b.margin - b.y[:, None], np.ones_like(b.margin)
    else:
        e = np.exp(b.margin - b.margin.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        g, h = p - (b.y[:, None] == np.arange(b.margin.shape[1])), np.maximum(p * (1 - p), 1e-16)
    return g * b.w[:, None], h * b.w[:, None]


def histograms(b: Block, loss: str, trees: list[np.ndarray], wanted: list[list[int]], columns: np.ndarray, width: int, share: float, salt: int):
    """(gradient, Hessian, rows) of each wanted node, feature of ``columns`` and bin; the last bin is of unknown values."""
    if share < 1:
        b = b.where(b.chosen(share, salt))
    g, h = gradients(b, loss)
    d, out = len(columns), []
    for k, (tree, nodes) in enumerate(zip(trees, wanted)):
        if not nodes:
            continue
        slot = np.full(tree.shape[1], -1)
        slot[nodes] = np.arange(len(nodes))
        place = slot[routed(b.x, tree)]
        some = np.flatnonzero(place >= 0)
        bins = b.x[some[:, None], columns].astype(np.int64)
        at = ((place[some, None] * d + np.arange(d)) * width + np.where(bins < 0, width - 1, bins)).reshape(-1)
        size = len(nodes) * d * width
        sums = [np.bincount(at, np.repeat(v, d), size) for v in (g[some, k], h[some, k])]
        out.append(np.stack([*sums, np.bincount(at, minlength=size)]).reshape(3, len(nodes), d, width))
    return (np.concatenate(out, axis=1),)


def _score(g: np.ndarray, h: np.ndarray, p: Growth) -> np.ndarray:
    return (np.maximum(np.abs(g) - p.l1, 0) ** 2 if p.l1 else g * g) / (h + (p.l2 + 1e-300))


def best_split(hist: np.ndarray, p: Growth):
    """(gain, feature, border, unknown go left, rows left) of one node's histogram (3, features, bins); gain 0: none."""
    known, unknown = hist[:, :, :-1], hist[:, :, -1]
    total = hist[:, 0].sum(1)
    best = (0.0, -1, 0, False, 0)
    if total[2] < 2 * max(p.least_rows, 1) or total[1] < 2 * p.least_hessian:
        return best
    prefix = np.cumsum(known, axis=2)  # the last: all known rows against the unknown ones
    base = _score(total[0], total[1], p)
    for to_left in (False, True) if unknown[2].any() else (False,):
        left = prefix + unknown[:, :, None] if to_left else prefix
        right = total[:, None, None] - left
        gain = (_score(left[0], left[1], p) + _score(right[0], right[1], p) - base) / 2 - p.gamma
        fit = (np.minimum(left[2], right[2]) >= max(p.least_rows, 1)) & (np.minimum(left[1], right[1]) >= p.least_hessian)
        gain = np.where(fit, gain, 0)
        at = int(gain.argmax())
        if gain.flat[at] > best[0] + 1e-12:
            f, c = divmod(at, gain.shape[1])
            best = (float(gain.flat[at]), f, c, to_left, int(left[2].flat[at]))
    return best


@dataclass
class Node:
    hist: np.ndarray
    depth: int
    split: tuple
    children: tuple[int, int] | None = None


class Grower:
    """One tree over some columns: ``virtual`` holds every node whose sums are known, the tree proper what is picked of them."""

    def __init__(self, p: Growth, columns: np.ndarray):
        self.p, self.columns = p, columns
        self.virtual, self.nodes = Tree(), {}

    def wanted(self) -> list[int]:
        """Nodes to sum next: the root, or the child with fewer rows of each leaf that may be split."""
        if not self.nodes:
            return [0]
        out = []
        for k in self._picks(known_only=False):
            node = self.nodes[k]
            if node.children is None:
                gain, f, border, unknown_left, n_left = node.split
                left = self.virtual.split(k, int(self.columns[f]), border, unknown_left)
                node.children = (left, left + 1)
                total = int(node.hist[2, 0].sum())
                out.append(left if 2 * n_left <= total else left + 1)
        return out

    def take(self, summed: list[int], hists: np.ndarray) -> None:
        for k, hist in zip(summed, np.moveaxis(hists, 1, 0)):
            if k == 0:
                self._known(0, hist, 0)
                continue
            parent = next(n for n in self.nodes.values() if n.children and k in n.children)
            other = sum(parent.children) - k
            self._known(k, hist, parent.depth + 1)
            self._known(other, parent.hist - hist, parent.depth + 1)

    def _known(self, k: int, hist: np.ndarray, depth: int) -> None:
        deep = self.p.depth is not None and depth >= self.p.depth
        self.nodes[k] = Node(hist, depth, (0.0, -1, 0, False, 0) if deep else best_split(hist, self.p))

    def _picks(self, known_only: bool) -> list[int]:
        """Leaves in the order in which they are split, up to the bound on leaves. Where the children of one
        aren't known yet, leaves behind it count too, unless ``known_only``: they may come first or later."""
        leaves, open_, out = 1, [0], []
        while open_ and (self.p.leaves is None or leaves < self.p.leaves):
            k = max(open_, key=lambda n: (self.nodes[n].split[0], -n))
            open_.remove(k)
            node = self.nodes[k]
            if node.split[0] <= 0:
                break
            out.append(k)
            leaves += 1
            if node.children and node.children[0] in self.nodes:
                open_ += node.children
            elif known_only:
                break
        return out

    def finished(self, rate: float) -> np.ndarray:
        """The tree of the picked splits, its leaves' values times ``rate``."""
        out, p, place = Tree(), self.p, {0: 0}
        for k in self._picks(known_only=True):
            _, f, border, unknown_left, _ = self.nodes[k].split
            left = out.split(place[k], int(self.columns[f]), border, unknown_left)
            for child, at in zip(self.nodes[k].children, (left, left + 1)):
                place[child] = at
        for k, at in place.items():
            g, h = self.nodes[k].hist[0, 0].sum(), self.nodes[k].hist[1, 0].sum()
            out.value[at] = float(-rate * np.sign(g) * max(abs(g) - p.l1, 0) / (h + p.l2)) if h + p.l2 > 0 else 0.0
        return out.arrays()


def _start(b: Block, classes: int):
    return (b.w.sum(), b.w @ b.y) if classes == 1 else (b.w.sum(), *(b.w @ (b.y == k) for k in range(classes)))


def fit(rows: Held | Spread, p: Growth, classes: int = 1) -> dict[str, np.ndarray]:
    """Boosted trees of the squared error (one class) or the softmax of ``classes``."""
    borders = cuts(rows, p.bins)
    bins = rows.mapped(binned, borders)
    loss = "squared" if classes == 1 else "softmax"
    total, *parts = rows.sum(_start, classes)
    start = np.array(parts) / total if classes == 1 else np.log(np.maximum(np.array(parts) / total, 1e-12))
    bins.begin(classes)
    bins.advance(_constant, start)
    width = max((len(c) for c in borders), default=0) + 2
    d, trees = len(borders), []
    for t in range(p.rounds):
        rng = np.random.default_rng((p.seed, t))
        columns = np.sort(rng.permutation(d)[: max(1, round(p.column_share * d))])
        growers = [Grower(p, columns) for _ in range(classes)]
        while any(wanted := [g.wanted() for g in growers]):
            (hists,) = bins.sum(histograms, loss, [g.virtual.arrays() for g in growers], wanted, columns, width, p.row_share, p.seed + t)
            at = 0
            for g, nodes in zip(growers, wanted):
                g.take(nodes, hists[:, at : at + len(nodes)])
                at += len(nodes)
        new = [g.finished(p.rate) for g in growers]
        trees.append(new)
        bins.advance(stepped, new)
    bins.done()
    flat = [t for new in trees for t in new]
    at = np.cumsum([0, *(t.shape[1] for t in flat)])
    size = np.array([len(c) for c in borders])
    return {"borders": np.concatenate([*borders, np.zeros(0)]), "sizes": size, "nodes": np.concatenate(flat, axis=1), "at": at, "start": start}


def _constant(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.broadcast_to(start, (len(x), len(start)))


def margins(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    bins = binned(x, np.split(m["borders"], np.cumsum(m["sizes"])[:-1]))
    out = np.tile(m["start"], (len(x), 1))
    k = len(m["start"])
    for i, (a, b) in enumerate(zip(m["at"], m["at"][1:])):
        tree = m["nodes"][:, a:b]
        out[:, i % k] += tree[4][routed(bins, tree)]
    return out


def predict(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The value, or the class of the largest margin."""
    out = margins(m, x)
    return out[:, 0] if out.shape[1] == 1 else out.argmax(1)

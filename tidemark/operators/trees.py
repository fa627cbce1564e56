"""Boosted trees: nodes, predictions, Shapley values, and the choice of a split from histograms, whoever has summed them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: Bins of a feature, the rows (by weight) that a side needs, and the penalty on leaf values.
BINS, LEAST, RIDGE = 32, 5.0, 1.0


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for a, x in ((self.feature, -1), (self.cut, 0.0), (self.missing_left, True), (self.left, -1), (self.right, -1), (self.value, value), (self.cover, cover)):
            a.append(x)
        return len(self.feature) - 1

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature[node]]
        return np.where(np.isnan(v), self.missing_left[node], v <= self.cut[node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                go = self.goes_left(node, x[rows])
                stack += [(self.left[node], rows[go]), (self.right[node], rows[~go])]
        return out

    def mean(self) -> float:
        """The value of a row of which nothing is known."""
        leaves = [n for n, f in enumerate(self.feature) if f < 0]
        return float(np.average([self.value[n] for n in leaves], weights=[self.cover[n] for n in leaves]))

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values, exact, in time that grows with leaves and the square of their depth.

        A leaf counts its value times, for each feature on its path, whether the row follows it there (``o``) or else the share of rows that do (``z``). The Shapley weights of
        the subsets of the others are moments of a uniform variable, so their sum is the integral of the product of ``z (1 - y) + o y``: a polynomial,
        which Gauss-Legendre nodes integrate exactly.
        """
        out = np.zeros(x.shape)
        go = {n: self.goes_left(n, x) for n, f in enumerate(self.feature) if f >= 0}
        stack: list[tuple[int, dict[int, tuple[float, np.ndarray]]]] = [(0, {})]
        while stack:
            node, path = stack.pop()
            f = self.feature[node]
            if f >= 0:
                left, right = self.left[node], self.right[node]
                whole = self.cover[left] + self.cover[right]
                z, o = path.get(f, (1.0, np.ones(len(x), bool)))
                stack.append((left, path | {f: (z * self.cover[left] / whole, o & go[node])}))
                stack.append((right, path | {f: (z * self.cover[right] / whole, o & ~go[node])}))
            elif path:
                nodes, weights = np.polynomial.legendre.leggauss(len(path) // 2 + 1)
                for y, w in zip((nodes + 1) / 2, weights / 2, strict=True):
                    terms = {k: np.where(o, z * (1 - y) + y, z * (1 - y)) for k, (z, o) in path.items()}
                    product = self.value[node] * w * np.prod(list(terms.values()), axis=0)
                    for k, (z, o) in path.items():
                        out[:, k] += product / terms[k] * (o - z)
        return out


@dataclass
class Boosted:
    trees: list[Tree]
    base: float
    rate: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Of the margin."""
        return self.rate * sum((t.shapley(x) for t in self.trees), np.zeros(x.shape))


def cuts_of(column: np.ndarray) -> list[float]:
    """Where a feature's values are cut into bins: those at ranks an even grid of BINS apart, each once."""
    own = np.sort(column[np.isfinite(column)])
    at = [int(k * (len(own) - 1) / BINS + 0.5) for k in range(1, BINS)]
    return sorted(set(own[at].tolist())) if len(own) else []


def coded(x: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """The bin of each value, one byte each; missing values have the bin after the last."""
    if not x.shape[1]:
        return np.zeros(x.shape, np.uint8)
    return np.stack([np.where(np.isnan(c), len(k) + 1, np.searchsorted(np.asarray(k, float), c, side="left")) for c, k in zip(x.T, cuts, strict=True)], axis=1).astype(np.uint8)


def histograms(codes: np.ndarray, node: np.ndarray, n_nodes: int, values: Sequence[np.ndarray]) -> np.ndarray:
    """Sums of ``values`` by node, feature and bin; rows with a negative node don't count."""
    n_cells = BINS + 2
    out = np.zeros((len(values), n_nodes, codes.shape[1], n_cells))
    there = node >= 0
    at = node[there].astype(np.int64) * n_cells
    for f in range(codes.shape[1]):
        cell = at + codes[there, f]
        for k, v in enumerate(values):
            out[k, :, f] = np.bincount(cell, weights=v[there], minlength=n_nodes * n_cells).reshape(n_nodes, n_cells)
    return out


def best_split(g: np.ndarray, h: np.ndarray, c: np.ndarray, cuts: Sequence[Sequence[float]], features: Sequence[int]) -> tuple[int, int, bool] | None:
    """Feature, cut and side of missing values with the most gain, from the node's histograms (feature, bin); the first of equals, None without gain."""
    best: tuple[float, tuple[int, int, bool] | None] = (1e-9, None)
    for f in features:
        k = len(cuts[f])
        gs, hs, cs = g[f].sum(), h[f].sum(), c[f].sum()
        gl, hl, cl = (np.cumsum(a[f, :k]) for a in (g, h, c))
        for miss in (True, False):
            a, b, n = (gl + g[f, k + 1], hl + h[f, k + 1], cl + c[f, k + 1]) if miss else (gl, hl, cl)
            ok = (n >= LEAST) & (cs - n >= LEAST)
            gain = np.where(ok, a * a / (b + RIDGE) + (gs - a) ** 2 / (hs - b + RIDGE) - gs * gs / (hs + RIDGE), 0.0)
            if len(gain) and gain.max() > best[0] * (1 + 1e-9):
                best = (float(gain.max()), (f, int(gain.argmax()), miss))
    return best[1]


class Growing:
    """A tree while it grows, level by level, on rows known by their bins."""

    def __init__(self, cuts: Sequence[Sequence[float]], features: Sequence[int], depth: int):
        self.cuts, self.features, self.depth, self.level = cuts, list(features), depth, 0
        self.tree, self.bins = Tree(), {}
        self.frontier: list[int] = []

    def route(self, codes: np.ndarray) -> np.ndarray:
        """For each row the place in the frontier of the node that it is in, -1 for a finished leaf."""
        if not self.tree.feature:
            return np.zeros(len(codes), np.int64)
        place = {n: i for i, n in enumerate(self.frontier)}
        leaf = self.leaves(codes)
        table = np.array([place.get(n, -1) for n in range(len(self.tree.feature))], np.int64)
        return table[leaf]

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf that each row is in."""
        at = np.zeros(len(codes), np.int64)
        for node, (j, last, miss) in self.bins.items():  # in order of making, so above comes before below
            mine = np.flatnonzero(at == node)
            code = codes[mine, self.tree.feature[node]]
            left = np.where(code > last, miss, code <= j)
            at[mine] = np.where(left, self.tree.left[node], self.tree.right[node])
        return at

    @property
    def n_nodes(self) -> int:
        return len(self.frontier) if self.tree.feature else 1

    def grow(self, g: np.ndarray, h: np.ndarray, c: np.ndarray) -> bool:
        """Splits the frontier by its histograms (node, feature, bin); whether there is another level."""
        if not self.tree.feature:
            some = self.features[0] if self.features else 0
            self.frontier = [self.tree.add(float(g[0, some].sum() / (h[0, some].sum() + RIDGE)), float(c[0, some].sum()))]
        made = []
        for i, node in enumerate(self.frontier):
            found = best_split(g[i], h[i], c[i], self.cuts, self.features) if self.level < self.depth else None
            if not found:
                continue
            f, j, miss = found
            k = len(self.cuts[f])
            t = self.tree
            t.feature[node], t.cut[node], t.missing_left[node] = f, float(self.cuts[f][j]), miss
            self.bins[node] = (j, k, miss)
            left = np.array([a[i, f, : j + 1].sum() + (a[i, f, k + 1] if miss else 0.0) for a in (g, h, c)])
            right = np.array([a[i, f].sum() for a in (g, h, c)]) - left
            t.left[node], t.right[node] = (t.add(float(s[0] / (s[1] + RIDGE)), float(s[2])) for s in (left, right))
            made += [t.left[node], t.right[node]]
        self.frontier, self.level = made, self.level + 1
        return bool(made) and self.level < self.depth


def start(wy: float, w: float) -> float:
    """The margin that a model begins with: the log odds of the weighted share of wins."""
    p = np.clip(wy / w, 1e-6, 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def slopes(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return w * (y - p), w * p * (1 - p)


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, trees: int = 60, depth: int = 3, rate: float = 0.1, cuts: Sequence[Sequence[float]] | None = None) -> Boosted:
    """A binary classifier by second-order boosting, all in this process; deterministic."""
    w = np.ones(len(y)) if w is None else w
    cuts = [cuts_of(c) for c in x.T] if cuts is None else cuts
    codes = coded(x, cuts)
    model = Boosted([], start(float((w * y).sum()), float(w.sum())), rate)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        g, h = slopes(y, w, margin)
        own = Growing(cuts, range(x.shape[1]), depth)
        more = True
        while more:
            more = own.grow(*histograms(codes, own.route(codes), own.n_nodes, (g, h, w)))
        margin = margin + rate * np.array(own.tree.value)[own.leaves(codes)]
        model.trees.append(own.tree)
    return model

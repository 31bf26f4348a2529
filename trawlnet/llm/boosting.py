"""Gradient-boosted trees for a yes/no label, on few features, in numpy: logistic loss, Newton leaves, binned splits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at]
            f = np.maximum(self.feature[at], 0)
            at = np.where(inner, 2 * at + 1 + (x[np.arange(len(x)), f] > self.cut[at]), at)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, ridge: float, least: int) -> Tree:
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
    where = np.zeros(len(x), np.int64)
    for node in range(size):
        mine = np.flatnonzero(where == node)
        if not len(mine):
            continue
        total_g, total_h = g[mine].sum(), h[mine].sum()
        tree.value[node] = -total_g / (total_h + ridge)
        if node >= 2**depth - 1:
            continue
        best = (1e-9, -1, 0.0)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            b = np.searchsorted(edges, x[mine, f])
            left_g = np.cumsum(np.bincount(b, g[mine], len(edges) + 1))[:-1]
            left_h = np.cumsum(np.bincount(b, h[mine], len(edges) + 1))[:-1]
            left_n = np.cumsum(np.bincount(b, minlength=len(edges) + 1))[:-1]
            gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
            gain[(left_n < least) | (len(mine) - left_n < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, edges[k])
        if best[1] >= 0:
            tree.feature[node], tree.cut[node] = best[1], best[2]
            where[mine] = 2 * node + 1 + (x[mine, best[1]] > best[2])
    return tree


@dataclass
class Boosted:
    """fit() finds the trees; margin() is their sum; calibrate() maps margins to observed rates on rows held out."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    ridge: float = 1.0
    least: int = 4
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = []
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            v = v if len(v) <= 33 else np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)))
            cuts.append((v[1:] + v[:-1]) / 2)
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(x, p - y, p * (1 - p), cuts, self.depth, self.ridge, self.least)
            self.trees.append(tree)
            margin += self.rate * tree.predict(x)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * tree.predict(x)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Isotonic regression (pool adjacent violators) of the label on the margin, with a half count of either label in each pool."""
        m = self.margin(x)
        order = np.argsort(m, kind="stable")
        pools: list[list[float]] = []
        for margin, label in zip(m[order], y[order]):
            pools.append([label, 1.0, margin])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                label, n, top = pools.pop()
                pools[-1] = [pools[-1][0] + label, pools[-1][1] + n, top]
        self.steps = np.array([p[2] for p in pools])
        self.levels = np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return self.levels[np.minimum(np.searchsorted(self.steps, self.margin(x)), len(self.levels) - 1)]

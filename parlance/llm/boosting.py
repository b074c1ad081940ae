"""Gradient-boosted trees for two classes, small enough to be sent with a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A complete binary tree: nodes 1 .. 2^depth - 1 split, the leaves follow."""

    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(len(self.value).bit_length() - 1):
            at = 2 * at + (x[rows, self.feature[at]] > self.above[at])
        return self.value[at - len(self.value)]


class Boosted:
    """Logistic loss, Newton leaf values, splits between quantiles of each feature."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.trees: list[Tree] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
        mean = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, cuts, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            score += tree(x)
        return self

    def _tree(self, binned, cuts, gradient, curvature) -> Tree:
        leaves = 1 << self.depth
        feature, above, value = np.zeros(leaves, np.int64), np.full(leaves, np.inf), np.zeros(leaves)
        groups = {1: np.arange(len(gradient))}
        for node in range(1, leaves):
            rows = groups.pop(node, None)
            if rows is None or not len(rows):
                continue
            g, h, best = gradient[rows], curvature[rows], (1e-6, -1, -1)
            whole = g.sum() ** 2 / (h.sum() + self.ridge)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, f], weights=g, minlength=len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], weights=h, minlength=len(c) + 1))[:-1]
                gain = gs**2 / (hs + self.ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.ridge) - whole
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            right = np.zeros(len(rows), bool)
            if best[1] >= 0:
                feature[node], above[node] = best[1], cuts[best[1]][best[2]]
                right = binned[rows, best[1]] > best[2]
            groups[2 * node], groups[2 * node + 1] = rows[~right], rows[right]
        for node in range(leaves, 2 * leaves):
            rows = groups.get(node)
            if rows is not None and len(rows):
                value[node - leaves] = self.rate * gradient[rows].sum() / (curvature[rows].sum() + self.ridge)
        return Tree(feature, above, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        return self.start + sum((t(x) for t in self.trees), np.zeros(len(x)))

"""Gradient-boosted trees for a yes/no label, in numpy: logistic loss, histogram splits, fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of depth ``depth`` as arrays: a node's feature and cut, then the leaves' values."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, smooth: float = 1.0, bins: int = 32):
        self.trees, self.depth, self.rate, self.smooth, self.bins = trees, depth, rate, smooth, bins
        self.base, self.features, self.cuts, self.leaves = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        grid = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(g, x[:, f], "left") for f, g in enumerate(grid)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            features, cuts = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first = 2**level - 1
                for n in range(2**level):
                    here = np.flatnonzero(node == n)
                    best = (1e-6, 0, None)
                    g_all, h_all = grad[here].sum(), hess[here].sum()
                    for f, g in enumerate(grid):
                        if not len(g) or len(here) < 4:
                            continue
                        size = len(g) + 1
                        left_g = np.cumsum(np.bincount(binned[here, f], grad[here], size))[:-1]
                        left_h = np.cumsum(np.bincount(binned[here, f], hess[here], size))[:-1]
                        gain = left_g**2 / (left_h + self.smooth) + (g_all - left_g) ** 2 / (h_all - left_h + self.smooth) - g_all**2 / (h_all + self.smooth)
                        b = int(gain.argmax())
                        if gain[b] > best[0]:
                            best = (gain[b], f, g[b])
                    if best[2] is not None:
                        features[first + n], cuts[first + n] = best[1], best[2]
                node = 2 * node + (x[np.arange(len(y)), features[first + node]] > cuts[first + node])
            total = np.bincount(node, grad, 2**self.depth) / (np.bincount(node, hess, 2**self.depth) + self.smooth)
            leaf = self.rate * total
            margin += leaf[node]
            self.features.append(features)
            self.cuts.append(cuts)
            self.leaves.append(leaf)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                node = 2 * node + (x[rows, features[first + node]] > cuts[first + node])
            margin += leaves[node]
        return 1 / (1 + np.exp(-margin))

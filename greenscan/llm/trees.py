"""Gradient-boosted binary classification trees on histograms of the features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    cuts: list[np.ndarray]      # feature -> ascending bin edges
    feature: np.ndarray         # (tree, inner node): feature, -1: go left always
    edge: np.ndarray            # (tree, inner node): bins above it go right
    leaf: np.ndarray            # (tree, leaf): added to the log-odds
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        rows = np.arange(len(b))
        out = np.full(len(b), self.base)
        inner = self.feature.shape[1]
        for f, e, v in zip(self.feature, self.edge, self.leaf):
            at = np.zeros(len(b), dtype=np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + ((f[at] >= 0) & (b[rows, f[at]] > e[at]))
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4,
          rate: float = 0.25, bins: int = 32, ridge: float = 5.0) -> Forest:
    """Logistic loss; every level splits all its nodes on the best of all features and edges."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    inner = 2 ** depth - 1
    forest = Forest(cuts, np.full((trees, inner), -1), np.zeros((trees, inner), np.int64),
                    np.zeros((trees, inner + 1)), float(np.log(share / (1 - share))))
    b = forest.bins(x)
    odds = np.full(len(y), forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            local = at - first
            best = np.zeros(width)
            for j in range(x.shape[1]):
                slot = local * bins + b[:, j]
                gs = np.bincount(slot, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(slot, h, width * bins).reshape(width, bins).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga ** 2 / (ha + ridge)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best + 1e-9
                forest.feature[t, first:first + width][better] = j
                forest.edge[t, first:first + width][better] = k[better]
                best = np.where(better, top, best)
            f, e = forest.feature[t, at], forest.edge[t, at]
            at = 2 * at + 1 + ((f >= 0) & (b[np.arange(len(y)), f] > e))
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        forest.leaf[t] = value
        odds += value[leaf]
    return forest

"""Gradient-boosted trees on histograms: fitted by numpy on a bounded sample, kept as arrays, applied to many rows at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Complete binary trees of one depth. Node i of a tree has the children 2 i + 1 and 2 i + 2; leaves are numbered apart."""

    base: float
    feature: np.ndarray  # tree, inner node
    threshold: np.ndarray  # tree, inner node: larger values go right
    leaf: np.ndarray  # tree, leaf

    def logits(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees level by level; there is no loop over rows or nodes."""
        n, trees = len(x), np.arange(len(self.feature))[None, :]
        node = np.zeros((n, len(self.feature)), np.int64)
        depth = self.leaf.shape[1].bit_length() - 1 if len(self.leaf) else 0
        rows = np.arange(n)[:, None]
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.leaf[trees, node - (2 ** depth - 1)].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
        ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic loss, second-order gains. ``least``: smallest sum of hessians in a leaf. One class only gives a constant."""
    n, width = x.shape if len(x) else (0, 1)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    cell = binned + np.arange(width) * bins
    inner = 2 ** depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    logit = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            where = ((node - first)[:, None] * (width * bins) + cell).ravel()
            shape = (count, width, bins)
            gs = np.bincount(where, np.repeat(g, width), count * width * bins).reshape(shape).cumsum(axis=2)
            hs = np.bincount(where, np.repeat(h, width), count * width * bins).reshape(shape).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs ** 2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga ** 2 / (ha + ridge)
            gain[(hs < least) | (ha - hs < least)] = 0
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            right = x[np.arange(n), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        which = node - inner
        leaf[t] = -rate * np.bincount(which, g, inner + 1) / (np.bincount(which, h, inner + 1) + ridge)
        logit += leaf[t, which]
    return Trees(base, feature, threshold, leaf)

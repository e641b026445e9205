"""Gradient-boosted regression trees for two classes, on binned features in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees as arrays: node i splits on ``feature[i]`` at ``cut[i]`` (left if value <= cut), its children are 2i+1 and 2i+2."""

    base: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; every level of a tree takes each node's best split over histogram bins.

    A node without a gain splits at infinity, so all its rows go left.  One class only: no tree, the base alone decides.
    """
    n, width = x.shape
    mean = (y.sum() + 0.5) / (n + 1)
    model = Boosted(float(np.log(mean / (1 - mean))), depth)
    if n == 0 or len(set(y.tolist())) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            own = at - first
            best = np.zeros(nodes)
            total_g, total_h = np.bincount(own, g, nodes), np.bincount(own, h, nodes)
            for f in range(width):
                k = len(edges[f])
                if not k:
                    continue
                slot = own * (k + 1) + binned[:, f]
                left_g = np.cumsum(np.bincount(slot, g, nodes * (k + 1)).reshape(nodes, k + 1), axis=1)[:, :-1]
                left_h = np.cumsum(np.bincount(slot, h, nodes * (k + 1)).reshape(nodes, k + 1), axis=1)[:, :-1]
                rg, rh = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + rg**2 / (rh + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(left_h < 0.5) | (rh < 0.5)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(nodes), top] > best + 1e-9
                best[better] = gain[np.arange(nodes), top][better]
                feature[first : first + nodes][better] = f
                cut[first : first + nodes][better] = edges[f][top[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        model.feature.append(feature), model.cut.append(cut), model.value.append(value)
    return model

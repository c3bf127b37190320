"""Histogram gradient-boosted trees for a yes/no label, kept as flat arrays.

Fitting bins every feature by quantiles of the sample, then grows each tree level by level from
per-node histograms of gradients and curvatures (logistic loss). A fitted model is six arrays;
prediction walks all rows down one tree at a time with numpy indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``trees`` complete binary trees of ``depth`` levels, node after node.

    Node n of tree t is at t * nodes + n, its children at 2n + 1 and 2n + 2. A row goes right if
    its ``feature`` is above ``cut``; an unsplit node has cut infinity. Leaves hold log-odds.
    """

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        inner, leaves = 2**self.depth - 1, 2**self.depth
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for t in range(len(self.leaf) // leaves):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = t * inner + at
                at = 2 * at + 1 + (rows[every, self.feature[node]] > self.cut[node])
            total += self.leaf[t * leaves + at - inner]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        return 1 / (1 + np.exp(-self.log_odds(rows)))


def fit(
    rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: float = 5.0
) -> Trees:
    """Fit on ``rows`` x features and 0/1 ``labels``. Without rows, or with one label, the score is constant.

    ``least``: least sum of curvature of a child; ``smooth``: penalty on leaf values.
    """
    n, width = rows.shape
    positive = (labels.sum() + 0.5) / (n + 1)
    base = float(np.log(positive / (1 - positive)))
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros(trees * inner, np.int64)
    cut = np.full(trees * inner, np.inf)
    leaf = np.zeros(trees * leaves)
    if not n or labels.min() == labels.max():
        return Trees(base, depth, feature, cut, leaf)
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, j], "left") for j, e in enumerate(edges)])
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = p - labels, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            for j, e in enumerate(edges):
                size = len(e) + 1
                slot = (at - first) * size + binned[j]
                g = np.cumsum(np.bincount(slot, gradient, count * size).reshape(count, size), axis=1)
                h = np.cumsum(np.bincount(slot, curvature, count * size).reshape(count, size), axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + smooth) + (all_g - g) ** 2 / (all_h - h + smooth) - all_g**2 / (all_h + smooth)
                gain[(h < least) | (all_h - h < least)] = -1
                pick = gain[:, :-1].argmax(axis=1) if size > 1 else np.zeros(count, int)
                value = gain[np.arange(count), pick]
                for node in np.flatnonzero(value > best) if size > 1 else ():
                    best[node] = value[node]
                    feature[t * inner + first + node], cut[t * inner + first + node] = j, e[pick[node]]
            node = t * inner + at
            at = 2 * at + 1 + (rows[np.arange(n), feature[node]] > cut[node])
        g = np.bincount(at - inner, gradient, leaves)
        h = np.bincount(at - inner, curvature, leaves)
        values = -rate * g / (h + smooth)
        leaf[t * leaves: (t + 1) * leaves] = values
        margin += values[at - inner]
    return Trees(base, depth, feature, cut, leaf)

"""Gradient-boosted trees for a yes/no label, in numpy: fitted on a bounded sample on the driver, applied inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete trees of equal depth: per inner node a feature and a limit, per leaf a value."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > limit[node])
            out += value[node - len(feature)]
        return out


def boost(rows: np.ndarray, label: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss over binned features."""
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    inner = 2**depth - 1
    base = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(base / (1 - base)))
    score = np.full(len(rows), start)
    features, limits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = label - p, p * (1 - p)
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain = np.zeros(width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = (node - first) * BINS + binned[:, j]
                g = np.bincount(cell, weights=slope, minlength=width * BINS).reshape(width, BINS)
                h = np.bincount(cell, weights=bend, minlength=width * BINS).reshape(width, BINS)
                left_g, left_h = g.cumsum(1)[:, : len(c)], h.cumsum(1)[:, : len(c)]
                all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                own = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                best = own.argmax(1)
                better = own[np.arange(width), best] > gain + 1e-9
                gain = np.where(better, own[np.arange(width), best], gain)
                feature[first : first + width][better] = j
                limit[first : first + width][better] = c[best][better]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > limit[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=slope, minlength=inner + 1) / (np.bincount(leaf, weights=bend, minlength=inner + 1) + ridge)
        score += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Trees(np.array(features), np.array(limits), np.array(values), start, depth)

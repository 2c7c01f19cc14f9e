"""Histogram gradient-boosted trees over small integer features, with logistic loss and Platt calibration.

Works on weighted cells (feature bins, positives, negatives), so a caller may
aggregate any number of rows into a bounded number of cells first.  Ties in
gain go to the lowest feature, then the lowest threshold: fitting the same
cells gives the same trees in any order of cells.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    base: float
    trees: list = field(default_factory=list)  # a leaf is a float, a split (feature, threshold, left, right): left if x <= threshold
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)

        def add(node, rows):
            if not isinstance(node, tuple):
                out[rows] += node
                return
            feature, threshold, left, right = node
            low = x[rows, feature] <= threshold
            add(left, rows[low])
            add(right, rows[~low])

        for t in self.trees:
            add(t, np.arange(len(x)))
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))


def _grow(x, grad, hess, rows, depth, rate, bins, l2):
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = float(-rate * g / (h + l2))
    if not depth or len(rows) < 2:
        return leaf
    best, cut = 1e-9, None
    for f in range(x.shape[1]):
        gl = np.cumsum(np.bincount(x[rows, f], weights=grad[rows], minlength=bins))[:-1]
        hl = np.cumsum(np.bincount(x[rows, f], weights=hess[rows], minlength=bins))[:-1]
        gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
        gain[(hl < 1e-3) | (h - hl < 1e-3)] = -1
        at = int(np.argmax(np.round(gain, 9))) if len(gain) else 0
        if len(gain) and gain[at] > best + 1e-9:
            best, cut = float(gain[at]), (f, at)
    if cut is None:
        return leaf
    low = x[rows, cut[0]] <= cut[1]
    left, right = (_grow(x, grad, hess, r, depth - 1, rate, bins, l2) for r in (rows[low], rows[~low]))
    return (cut[0], cut[1], left, right)


def fit(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Boosted:
    """Fits cells: x (cells, features) of integers from 0; weights of both classes per cell."""
    order = np.lexsort((negative, positive, *x.T[::-1]))
    x, positive, negative = x[order].astype(np.int64), positive[order].astype(float), negative[order].astype(float)
    total = positive + negative
    p = min(max(positive.sum() / max(total.sum(), 1), 1e-3), 1 - 1e-3) if len(x) else 0.5
    model = Boosted(float(np.log(p / (1 - p))))
    if not len(x):
        return model
    bins, score = int(x.max()) + 1, np.full(len(x), model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        tree = _grow(x, q * total - positive, total * q * (1 - q), np.arange(len(x)), depth, rate, bins, l2)
        if not isinstance(tree, tuple) and abs(tree) < 1e-12:
            break
        model.trees.append(tree)
        score = model.raw(x)
    return model


def calibrate(model: Boosted, x: np.ndarray, positive: np.ndarray, negative: np.ndarray, steps: int = 50) -> Boosted:
    """Platt scaling on cells that the trees were not fitted on."""
    s, total = model.raw(x), positive + negative
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-(a * s + b)))
        r, w = q * total - positive, np.maximum(total * q * (1 - q), 1e-9)
        g = np.array([(r * s).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * b])
        h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    model.slope, model.shift = float(a), float(b)
    return model

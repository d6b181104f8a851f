"""Gradient-boosted trees for two classes, in numpy: small, exact and the same on every machine."""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Second-order boosting of the logistic loss with trees of fixed depth.

    A tree of depth d is arrays of 2^d - 1 features and thresholds and 2^d leaf values; a row goes right
    when its value is above the threshold.
    """

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, least: int = 8, smooth: float = 1.0, bins: int = 32):
        self.trees, self.depth, self.rate, self.least, self.smooth, self.bins = trees, depth, rate, least, smooth, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base, self.feature, self.cut, self.leaf = float(np.log(mean / (1 - mean))), [], [], []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = _sigmoid(score)
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node, inner = np.zeros(len(y), dtype=np.int64), (1 << self.depth) - 1
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                local = node - first
                best = np.full(width, 1e-9)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    size, at = len(c) + 1, local * (len(c) + 1) + binned[:, j]
                    sums = [np.bincount(at, w, width * size).reshape(width, size).cumsum(axis=1) for w in (g, h, None)]
                    gl, hl, nl = (s[:, :-1] for s in sums)
                    gt, ht, nt = (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + self.smooth) + (gt - gl) ** 2 / (ht - hl + self.smooth) - gt**2 / (ht + self.smooth)
                    gain[(nl < self.least) | (nt - nl < self.least)] = -np.inf
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    for w in np.flatnonzero(top > best):
                        best[w], feature[first + w], cut[first + w] = top[w], j, c[k[w]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.smooth)
            score += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1, before calibration."""
        x = np.asarray(x, dtype=np.float64)
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return _sigmoid(total)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities): a rising step function fitted by pooling neighbours that fall."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # first score, sum, count
    for s, v in zip(np.asarray(score)[order], np.asarray(y, dtype=float)[order], strict=True):
        blocks.append([float(s), float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s2, v2, n2 = blocks.pop()
            blocks[-1][1] += v2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])

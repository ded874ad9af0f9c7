"""Gradient-boosted trees for a few classes, on binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Softmax boosting of complete trees of fixed depth, grown level by level from histograms."""

    def __init__(self, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        n, width = binned.shape
        f = np.zeros((n, classes))
        hot = np.eye(classes)[y]
        inner = 2**self.depth - 1
        self.feature, self.split, self.leaf = [], [], []
        for _ in range(self.rounds):
            p = self._softmax(f)
            for c in range(classes):
                g, h = p[:, c] - hot[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                feature, split = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)
                node = np.zeros(n, np.int64)  # within its level
                for level in range(self.depth):
                    k = 2**level
                    at = (node[:, None] * width + np.arange(width)) * self.bins + binned
                    sums = [np.bincount(at.ravel(), np.repeat(v, width), k * width * self.bins).reshape(k, width, self.bins) for v in (g, h)]
                    left = [s.cumsum(2) for s in sums]
                    total = [s[:, :, -1:] for s in left]
                    gain = left[0] ** 2 / (left[1] + self.ridge) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + self.ridge)
                    best = gain[:, :, :-1].reshape(k, -1).argmax(1)
                    base = k - 1
                    feature[base : base + k], split[base : base + k] = best // (self.bins - 1), best % (self.bins - 1)
                    node = 2 * node + (binned[np.arange(n), feature[base + node]] > split[base + node])
                leaf = -self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.ridge)
                f[:, c] += leaf[node]
                self.feature.append(feature)
                self.split.append(split)
                self.leaf.append(leaf)
        self.classes = classes
        return self

    def log_probability(self, x: np.ndarray) -> np.ndarray:
        """ln p of each class for each row."""
        binned = self._bin(x)
        width = binned.shape[1]
        rows, f, flat = np.arange(len(x)) * width, np.zeros((len(x), self.classes)), binned.ravel()
        for t, (feature, split, leaf) in enumerate(zip(self.feature, self.split, self.leaf, strict=True)):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (flat.take(rows + feature[at]) > split[at])
            f[:, t % self.classes] += leaf[node]
        return np.log(np.maximum(self._softmax(f), 1e-9))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1).astype(np.uint8) if x.shape[1] else np.zeros(x.shape, np.int64)

    @staticmethod
    def _softmax(f: np.ndarray) -> np.ndarray:
        e = np.exp(f - f.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

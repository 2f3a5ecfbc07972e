"""Gradient-boosted trees for several classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosting:
    """Additive trees of fixed depth; each round fits one tree a class to the softmax gradient."""

    def __init__(self, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, bins: int = 32):
        self.classes, self.rounds, self.depth, self.rate, self.ridge, self.bins = classes, rounds, depth, rate, ridge, bins
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        """x: floats (rows, features); y: classes."""
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        out, one = np.zeros((len(x), self.classes)), np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            row = [self.tree(b, p[:, c] - one[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)) for c in range(self.classes)]
            for c, t in enumerate(row):
                out[:, c] += self.walk(t, b)
            self.trees.append(row)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete binary tree: the feature and bin that each inner node splits on, the leaves' values."""
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int32), np.full(inner, self.bins + 1, np.int32)
        at = np.zeros(len(b), np.int64)
        for level in range(self.depth):
            first, n = (1 << level) - 1, 1 << level
            node = at - first
            best = np.full(n, 1e-6)
            total_g, total_h = np.bincount(node, g, n), np.bincount(node, h, n)
            base = total_g**2 / (total_h + self.ridge)
            for j in range(b.shape[1]):
                key = node * (self.bins + 1) + b[:, j]
                left_g = np.bincount(key, g, n * (self.bins + 1)).reshape(n, -1).cumsum(axis=1)
                left_h = np.bincount(key, h, n * (self.bins + 1)).reshape(n, -1).cumsum(axis=1)
                gain = left_g**2 / (left_h + self.ridge) + (total_g[:, None] - left_g) ** 2 / (total_h[:, None] - left_h + self.ridge) - base[:, None]
                k = gain.argmax(axis=1)
                better = gain[np.arange(n), k] > best
                best = np.where(better, gain[np.arange(n), k], best)
                feature[first : first + n][better], cut[first : first + n][better] = j, k[better]
            at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
        leaf = at - inner
        return feature, cut, -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)

    def walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return value[at - len(feature)]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.zeros((len(x), self.classes))
        for row in self.trees:
            for c, t in enumerate(row):
                out[:, c] += self.walk(t, b)
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))

"""Gradient-boosted trees for two classes over binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, trees of fixed depth, Platt calibration on rows left out of the training."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        held = np.arange(len(y)) % 5 == 4
        self.cuts = [np.unique(np.quantile(x[~held, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x[~held])
        target = y[~held].astype(float)
        score = np.zeros(len(target))
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, target - p, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, binned)
        self.scale, self.shift = 1.0, 0.0
        raw, want = self._raw(x[held]), y[held].astype(float)
        for _ in range(50):  # Newton steps on scale and shift
            p = 1 / (1 + np.exp(-(self.scale * raw + self.shift)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - want) * raw).sum() + 1e-2 * (self.scale - 1), (p - want).sum() + 1e-2 * self.shift])
            hess = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(hess, grad)
            self.scale, self.shift = self.scale - 0.5 * step[0], self.shift - 0.5 * step[1]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1) if len(x) else np.empty((0, len(self.cuts)), int)

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Complete tree: split feature and bin of each inner node, value of each leaf."""
        inner = 2**self.depth - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, self.bins + 1), np.zeros(len(grad), int)
        width = self.bins + 1
        for level in range(self.depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                mine = node == k
                g, h, rows = grad[mine], hess[mine], binned[mine]
                best = 1e-6
                for j in range(binned.shape[1]):
                    gl = np.cumsum(np.bincount(rows[:, j], g, width))[:-1]
                    hl = np.cumsum(np.bincount(rows[:, j], h, width))[:-1]
                    gain = gl**2 / (hl + self.penalty) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.penalty) - g.sum() ** 2 / (h.sum() + self.penalty)
                    at = int(gain.argmax())
                    if gain[at] > best:
                        best, feature[k], cut[k] = gain[at], j, at
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        leaf = node - inner
        value = self.rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + self.penalty)
        return feature, cut, value

    def _walk(self, tree: tuple, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def _raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return sum((self._walk(t, binned) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self._raw(x) + self.shift)))

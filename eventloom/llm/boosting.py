"""Gradient-boosted decision trees for two classes, over binned features (numpy)."""

from __future__ import annotations

import numpy as np

BINS = 24


class BoostedTrees:
    """Complete trees of one depth; ``fit`` sees a bounded sample, ``predict`` any rows."""

    def __init__(self, n_trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.ridge = n_trees, depth, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, n_features = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.n_trees, inner), np.int64)
        self.cut = np.full((self.n_trees, inner), np.inf, np.float32)
        self.value = np.zeros((self.n_trees, leaves), np.float32)
        score = np.full(n, self.base)
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                chosen = np.zeros(width, np.int64)
                chosen_bin = np.full(width, BINS, np.int64)
                for f in range(n_features):
                    if not len(cuts[f]):
                        continue
                    slot = at * (BINS + 1) + binned[f]
                    g = np.bincount(slot, grad, width * (BINS + 1)).reshape(width, -1)
                    h = np.bincount(slot, hess, width * (BINS + 1)).reshape(width, -1)
                    gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain = gain[:, : len(cuts[f])]
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better], chosen[better], chosen_bin[better] = top[better], f, k[better]
                self.feature[t, first : first + width] = chosen
                self.cut[t, first : first + width] = [cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(chosen, chosen_bin, strict=True)]
                at = 2 * at + (binned[chosen[at], np.arange(n)] > chosen_bin[at])
            g, h = np.bincount(at, grad, leaves), np.bincount(at, hess, leaves)
            self.value[t] = -self.rate * g / (h + self.ridge)
            score += self.value[t][at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = at + 2**level - 1
                at = 2 * at + (x[rows, feature[node]] > cut[node])
            score += value[at]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

"""Gradient-boosted trees on histograms, level by level, in NumPy."""

from __future__ import annotations

import numpy as np


class HistogramBoosting:
    """Squared-error boosting with row and column sampling, minimal child weight and split penalty."""

    def __init__(self, n_estimators=300, max_depth=6, learning_rate=0.05, subsample=0.8, colsample_bytree=0.8, min_child_weight=3, gamma=1.0, reg_lambda=1.0, n_bins=64, seed=0):
        self.n_estimators, self.max_depth, self.learning_rate = int(n_estimators), int(max_depth), float(learning_rate)
        self.subsample, self.colsample, self.min_child = float(subsample), float(colsample_bytree), float(min_child_weight)
        self.gamma, self.reg_lambda, self.n_bins, self.seed = float(gamma), float(reg_lambda), int(n_bins), seed

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if x.shape[1] else np.empty((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Train; the predictions on ``x`` come back."""
        rng = np.random.default_rng(self.seed)
        n, p = x.shape
        self.edges = []
        for j in range(p):
            u = np.unique(x[:, j])
            if len(u) > self.n_bins:
                u = np.unique(np.quantile(u, np.linspace(0, 1, self.n_bins)))
            self.edges.append((u[:-1] + u[1:]) / 2)
        bins = self._bin(x)
        width = max([len(e) + 1 for e in self.edges], default=1)
        self.base = float(y.mean()) if n else 0.0
        out = np.full(n, self.base)
        self.trees = []
        for _ in range(self.n_estimators if p else 0):
            rows = np.flatnonzero(rng.random(n) < self.subsample) if self.subsample < 1 else np.arange(n)
            cols = np.sort(rng.choice(p, max(1, round(self.colsample * p)), replace=False))
            tree = self._grow(bins, y - out, rows, cols, width)
            self.trees.append(tree)
            out = out + self.learning_rate * self._leaf(tree, bins)
        return out

    def _grow(self, bins, g, rows, cols, width):
        """Heap-numbered nodes: split column (-1: leaf), last bin of the left side, value."""
        size = 2 ** (self.max_depth + 1)
        column, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.zeros(len(rows), int)
        live = np.array([0])
        gr = g[rows]
        for depth in range(self.max_depth + 1):
            k = len(live)
            slot = np.full(size, -1)
            slot[live] = np.arange(k)
            s = slot[node]
            on = s >= 0
            sums, counts = np.bincount(s[on], gr[on], k), np.bincount(s[on], minlength=k).astype(float)
            value[live] = sums / (counts + self.reg_lambda)
            if depth == self.max_depth:
                break
            best, gain = np.full((k, 2), -1), np.full(k, self.gamma)
            own = sums**2 / (counts + self.reg_lambda)
            for j in cols:
                key = s[on] * width + bins[rows[on], j]
                a = np.bincount(key, gr[on], k * width).reshape(k, width).cumsum(1)
                c = np.bincount(key, minlength=k * width).reshape(k, width).cumsum(1).astype(float)
                right = counts[:, None] - c
                score = a**2 / (c + self.reg_lambda) + (sums[:, None] - a) ** 2 / (right + self.reg_lambda) - own[:, None]
                # half the gain is what the penalty stands against
                score = np.where((c >= self.min_child) & (right >= self.min_child), score / 2, -1.0)
                b = score.argmax(axis=1)
                top = score[np.arange(k), b]
                better = top > gain
                gain[better] = top[better]
                best[better] = np.column_stack([np.full(k, j), b])[better]
            split = best[:, 0] >= 0
            if not split.any():
                break
            column[live[split]], cut[live[split]] = best[split, 0], best[split, 1]
            moving = on.copy()
            moving[on] = split[s[on]]
            nd = node[moving]
            node[moving] = 2 * nd + 1 + (bins[rows[moving], column[nd]] > cut[nd])
            node[on & ~moving] = size - 1  # done: no live slot
            live = np.sort(np.concatenate([2 * live[split] + 1, 2 * live[split] + 2]))
        return column, cut, value

    def _leaf(self, tree, bins):
        column, cut, value = tree
        node = np.zeros(len(bins), int)
        for _ in range(self.max_depth):
            inner = column[node] >= 0
            if not inner.any():
                break
            nd = node[inner]
            node[inner] = 2 * nd + 1 + (bins[inner, column[nd]] > cut[nd])
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self._bin(x)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out = out + self.learning_rate * self._leaf(tree, bins)
        return out

"""Gradient-boosted trees on histograms, for the small feature tables of this subpackage.

The fit runs on a bounded sample on the driver (``MAX_FIT_ROWS``); the model is a handful of plain
arrays, so scoring is a vectorised pass inside an Arrow batch with nothing to install on executors.
"""

from __future__ import annotations

import numpy as np

#: Bound of the labelled sample that a fit may use.
MAX_FIT_ROWS = 40_000


class Boosted:
    """Binary classifier with logistic loss. Leaves hold log-odds steps."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.forest = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        x = np.nan_to_num(np.asarray(x, dtype=np.float64))[:MAX_FIT_ROWS]
        y = np.asarray(y, dtype=np.float64)[:MAX_FIT_ROWS]
        w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=np.float64)[:MAX_FIT_ROWS]
        self.forest = []
        rate = (w @ y + 0.5) / (w.sum() + 1.0)
        self.base = float(np.log(rate / (1 - rate)))
        if len(y) == 0 or len(np.unique(y)) < 2:
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), w * p * (1 - p) + 1e-9
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth + 1):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if not len(rows):
                        continue
                    tree[k] = (-1, 0.0, self.rate * g[rows].sum() / (h[rows].sum() + 1.0))
                    if level < self.depth and len(rows) >= 2 * self.least:
                        best = self._split(codes[rows], g[rows], h[rows], [len(e) for e in edges])
                        if best:
                            j, b = best
                            tree[k] = (j, float(edges[j][b]), 0.0)
                            node[rows] = 2 * k + 1 + (codes[rows, j] > b)
            t = self._pack(tree)
            self.forest.append(t)
            f += self._apply(t, x)
        return self

    def _split(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, sizes: list[int]) -> tuple[int, int] | None:
        top, best = 1e-6, None
        total_g, total_h = g.sum(), h.sum()
        for j, n in enumerate(sizes):
            if not n:
                continue
            gs = np.bincount(codes[:, j], g, n + 1).cumsum()[:-1]
            hs = np.bincount(codes[:, j], h, n + 1).cumsum()[:-1]
            cs = np.bincount(codes[:, j], minlength=n + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(cs < self.least) | (len(g) - cs < self.least)] = 0
            b = int(gain.argmax())
            if gain[b] > top:
                top, best = gain[b], (j, b)
        return best

    @staticmethod
    def _pack(tree: list[tuple[int, float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.array(c) for c in zip(*tree, strict=True))

    def _apply(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, at, value = tree
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            j = feature[node]
            inner = j >= 0
            node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(j, 0)] > at[node]), node)
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        x = np.nan_to_num(np.asarray(x, dtype=np.float64))
        f = np.full(len(x), self.base)
        for tree in self.forest:
            f += self._apply(tree, x)
        return 1 / (1 + np.exp(-f))

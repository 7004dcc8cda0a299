"""Gradient-boosted trees for two classes over a small feature matrix, on arrays.

Features are cut into at most BINS bins at quantiles; trees are complete, of a
fixed depth, grown by the gain of the logistic loss. Fitting takes a bounded
sample on the driver; the model is three small arrays.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    def __init__(self, depth: int = 4, rounds: int = 60, rate: float = 0.25, smooth: float = 1.0):
        self.depth, self.rounds, self.rate, self.smooth = depth, rounds, rate, smooth

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.asarray(x, np.float32)
        self.cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS).astype(np.float32)) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(cut, x[:, j], side="left") for j, cut in enumerate(self.cuts)], axis=1)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.threshold = np.full((self.rounds, inner), np.inf, np.float32)
        self.leaf = np.zeros((self.rounds, inner + 1), np.float64)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.start)
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)  # breadth first: the children of i are 2i + 1, 2i + 2
            for i in range(inner):
                mine = np.flatnonzero(node == i)
                best = 1e-6
                if len(mine) > 1:
                    gm, hm, bm = g[mine], h[mine], b[mine]
                    whole = gm.sum() ** 2 / (hm.sum() + self.smooth)
                    for j, cut in enumerate(self.cuts):
                        if not len(cut):
                            continue
                        gl = np.cumsum(np.bincount(bm[:, j], gm, len(cut) + 1))[:-1]
                        hl = np.cumsum(np.bincount(bm[:, j], hm, len(cut) + 1))[:-1]
                        gain = gl**2 / (hl + self.smooth) + (gm.sum() - gl) ** 2 / (hm.sum() - hl + self.smooth) - whole
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, self.feature[t, i], self.threshold[t, i] = gain[k], j, cut[k]
                node[mine] = 2 * i + 1 + (x[mine, self.feature[t, i]] > self.threshold[t, i])
            for leaf in range(inner + 1):
                mine = node == inner + leaf
                self.leaf[t, leaf] = self.rate * g[mine].sum() / (h[mine].sum() + self.smooth)
            margin += self.leaf[t, node - inner]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of class 1."""
        x = np.ascontiguousarray(x, np.float32)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.threshold[t][node])
            out += self.leaf[t, node - (2**self.depth - 1)]
        return out

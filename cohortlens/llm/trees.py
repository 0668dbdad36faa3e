"""Gradient-boosted regression trees for a binary label, in numpy: histogram splits, logistic loss, full trees of fixed depth."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.l2 = rounds, depth, rate, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        f = np.full(n, self.start)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, bound, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
            node = np.zeros(n, np.int64)
            for node_id in range(inner):
                own = np.flatnonzero(node == node_id)
                if len(own) >= 20:
                    best = (1e-6, None)
                    gt, ht = g[own].sum(), h[own].sum()
                    for j in range(k):
                        if not len(edges[j]):
                            continue
                        size = len(edges[j]) + 1
                        gl = np.cumsum(np.bincount(b[own, j], weights=g[own], minlength=size))[:-1]
                        hl = np.cumsum(np.bincount(b[own, j], weights=h[own], minlength=size))[:-1]
                        gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                        gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), (j, i))
                    if best[1]:
                        j, i = best[1]
                        feature[node_id], bound[node_id] = j, edges[j][i]
                right = x[own, feature[node_id]] > bound[node_id]
                node[own] = 2 * node_id + 1 + right
            at = node - inner
            leaf = self.rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + self.l2)
            self.trees.append((feature, bound, leaf))
            f += leaf[at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = (1 << self.depth) - 1
        for feature, bound, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            f += leaf[node - inner]
        return 1 / (1 + np.exp(-f))

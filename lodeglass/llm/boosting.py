"""Small gradient-boosted trees for a bounded number of rows, with a calibrated threshold."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary logistic boosting of trees of fixed depth over quantile bins. Equal inputs give equal trees."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5, shrink: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.shrink = rounds, depth, rate, bins, least, shrink
        self.edges, self.trees, self.base = [], [], 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        b, score = self._binned(x), np.full(len(x), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(b, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._apply(tree, b)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray]:
        """Splits by level, a (feature, bin) for each node or None, and the values of the leaves."""
        node, levels = np.zeros(len(b), np.int64), []
        for level in range(self.depth):
            best: list = [(0.0, None)] * (1 << level)
            for j in range(b.shape[1]):
                width = len(self.edges[j]) + 1
                key, size = node * width + b[:, j], (1 << level) * width
                sums = [np.bincount(key, w, size).reshape(-1, width).cumsum(1) for w in (g, h, np.ones(len(b)))]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + self.shrink) + (gt - gl) ** 2 / (ht - hl + self.shrink) - gt**2 / (ht + self.shrink)
                gain[(nl < self.least) | (nt - nl < self.least)] = 0
                for k, (c, top) in enumerate(zip(gain.argmax(1), gain.max(1), strict=True)):
                    if top > best[k][0] + 1e-9:
                        best[k] = (top, (j, int(c)))
            levels.append([s for _, s in best])
            node = self._step(levels[-1], node, b)
        size = 1 << self.depth
        return levels, self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.shrink)

    @staticmethod
    def _step(splits: list, node: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = node * 2
        for k, s in enumerate(splits):
            if s:
                mine = node == k
                out[mine] += b[mine, s[0]] > s[1]
        return out

    def _apply(self, tree: tuple[list, np.ndarray], b: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        for splits in tree[0]:
            node = self._step(splits, node, b)
        return tree[1][node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        b = self._binned(x)
        return 1 / (1 + np.exp(-(self.base + sum(self._apply(t, b) for t in self.trees))))


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which rows of that score and above are at least as often positive; over 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.flatnonzero((right >= precision) & np.append(np.diff(p[order]) < 0, True)) if len(y) else []
    return float(p[order][last[-1]]) if len(last) and y.sum() else 2.0

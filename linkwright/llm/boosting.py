"""Gradient-boosted trees for a yes or no label over a few features, and isotonic calibration; numpy only, for bounded samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss; each tree splits on quantile bins down to `depth`, leaves are Newton steps."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty = trees, depth, rate, bins, penalty
        self.forest: list[list[tuple[int, float, float]]] = []  # a tree is a heap of (feature or -1, threshold, value)
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        if not len(y):
            return self
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, cuts, p - y, p * (1 - p))
            self.forest.append(tree)
            score += self._apply(tree, x)
        return self

    def _tree(self, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple[int, float, float]]:
        tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        inside = {0: np.arange(len(g))}
        for node in range(len(tree)):
            rows = inside.pop(node, None)
            if rows is None:
                continue
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            best, split = 1e-6, None
            if node < 2**self.depth - 1 and len(rows) > 10:
                for f, c in enumerate(cuts):
                    if len(c):
                        left_g = np.cumsum(np.bincount(binned[f, rows], g[rows], len(c) + 1))[:-1]
                        left_h = np.cumsum(np.bincount(binned[f, rows], h[rows], len(c) + 1))[:-1]
                        gain = left_g**2 / (left_h + self.penalty) + (sum_g - left_g) ** 2 / (sum_h - left_h + self.penalty) - sum_g**2 / (sum_h + self.penalty)
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, split = float(gain[k]), (f, k)
            if split is None:
                tree[node] = (-1, 0.0, float(-self.rate * sum_g / (sum_h + self.penalty)))
                continue
            f, k = split
            low = binned[f, rows] <= k
            inside[2 * node + 1], inside[2 * node + 2] = rows[low], rows[~low]
            tree[node] = (f, float(cuts[f][k]), 0.0)
        return tree

    @staticmethod
    def _apply(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, threshold, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            high = x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at]
            at = np.where(inner, 2 * at + 1 + high, at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.forest:
            score += self._apply(tree, x)
        return 1 / (1 + np.exp(-score))


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, share) of the non-decreasing fit, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # greatest score, sum, count
    for score, label in sorted(zip(p.tolist(), y.tolist(), strict=True)):
        blocks.append([score, label, 1])
        while len(blocks) > 1 and (blocks[-2][0] == blocks[-1][0] or blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]):
            score, total, n = blocks.pop()
            blocks[-1] = [score, blocks[-1][1] + total, blocks[-1][2] + n]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])

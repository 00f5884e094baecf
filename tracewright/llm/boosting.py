"""Small gradient-boosted trees for binary features of candidates: logistic loss, histogram splits, Platt calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth over features cut at given edges; predicts calibrated probabilities."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 16) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Every other row grows the trees, the rest calibrates them."""
        grow, held = slice(0, None, 2), slice(1, None, 2)
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned, target, raw = self._binned(x[grow]), y[grow].astype(float), np.zeros(len(y[grow]))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._tree(binned, p - target, p * (1 - p))
            self.trees.append(tree)
            raw += self._values(tree, binned)
        z, t = self.raw(x[held]), y[held].astype(float)
        for _ in range(300):
            error = 1 / (1 + np.exp(-(self.slope * z + self.shift))) - t
            self.slope -= 0.05 * float(np.mean(error * z))
            self.shift -= 0.05 * float(np.mean(error))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, self.bins + 1), np.zeros(len(x), int)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = 1e-9
            for f in range(x.shape[1]):
                gs, hs = (np.cumsum(np.bincount(x[own, f], v[own], self.bins + 1)) for v in (g, h))
                gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                if gain[:-1].max() > best:
                    best, feature[k], cut[k] = gain[:-1].max(), f, int(gain[:-1].argmax())
            node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, v, inner + 1) for v in (g, h))
        return feature, cut, -self.rate * gs / (hs + 1)

    def _values(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return sum((self._values(t, binned) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift))) if len(x) else np.empty(0)

"""Gradient-boosted trees for a binary label: fitted in numpy, scored as a Column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A split on ``feature <= cut``, or a leaf with ``value``."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.predict(x), self.high.predict(x))

    def sql(self, names: list[str]) -> str:
        if self.feature < 0:
            return f"{self.value!r}D"
        return f"if({names[self.feature]} <= {self.cut!r}D, {self.low.sql(names)}, {self.high.sql(names)})"


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    """Splits by the second-order gain, down to ``depth``."""
    best, total_g, total_h = (1e-6, -1, 0.0), grad.sum(), hess.sum()
    whole = total_g**2 / (total_h + ridge)
    for feature in range(x.shape[1]) if depth else ():
        order = np.argsort(x[:, feature], kind="stable")
        value, g, h = x[order, feature], np.cumsum(grad[order]), np.cumsum(hess[order])
        edge = np.flatnonzero((value[1:] > value[:-1]) & (h[:-1] >= least) & (total_h - h[:-1] >= least))
        if edge.size:
            gain = g[edge] ** 2 / (h[edge] + ridge) + (total_g - g[edge]) ** 2 / (total_h - h[edge] + ridge) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), feature, float((value[edge[k]] + value[edge[k] + 1]) / 2))
    if best[1] < 0:
        return Tree(value=float(-total_g / (total_h + ridge)))
    low = x[:, best[1]] <= best[2]
    sides = [_grow(x[m], grad[m], hess[m], depth - 1, least, ridge) for m in (low, ~low)]
    return Tree(feature=best[1], cut=best[2], low=sides[0], high=sides[1])


class Boosted:
    """A sum of trees on the log-odds scale."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 2.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.trees: list[Tree] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        margin = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(x, p - y, p * (1 - p), self.depth, self.least, self.ridge)
            self.trees.append(tree)
            margin += self.rate * tree.predict(x)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum(t.predict(x) for t in self.trees)

    def sql(self, names: list[str]) -> str:
        """The margin as a SQL expression over the features' names."""
        return f"{self.rate!r}D * (" + " + ".join(t.sql(names) for t in self.trees) + ")"


def threshold(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest margin from which on the share of true labels, among all at least as high, reaches ``precision``."""
    order = np.argsort(-margin, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.concatenate([margin[order][1:] != margin[order][:-1], [True]])
    good = np.flatnonzero((share >= precision) & last)
    return float(margin[order][good[-1]]) if good.size else float("inf")

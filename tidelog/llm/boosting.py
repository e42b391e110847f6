"""Small gradient-boosted trees for two classes, on arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Complete binary tree of ``depth``; a row goes right where its value is above."""

    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range((len(self.value)).bit_length() - 1):
            right = rows[np.arange(len(rows)), self.feature[node]] > self.above[node]
            node = 2 * node + 1 + right
        return self.value[node - len(self.feature)]


@dataclass
class BoostedTrees:
    """Logistic loss, Newton steps, thresholds at quantiles of each feature."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.2
    cuts: int = 24
    least: float = 1.0
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0

    def fit(self, rows: np.ndarray, wanted: np.ndarray) -> BoostedTrees:
        share = np.clip(wanted.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        raw = np.full(len(rows), self.base)
        places = np.linspace(0, 1, self.cuts + 2)[1:-1]
        cuts = [np.unique(np.quantile(column, places)) for column in rows.T]
        for _ in range(self.rounds):
            chance = 1 / (1 + np.exp(-raw))
            tree = self._tree(rows, cuts, chance - wanted, chance * (1 - chance))
            self.trees.append(tree)
            raw += tree.of(rows)
        return self

    def _tree(self, rows, cuts, gradient, weight) -> Tree:
        inner = 2**self.depth - 1
        feature, above = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), np.int64)
        for at in range(inner):
            inside = np.flatnonzero(node == at)
            if len(inside):
                feature[at], above[at] = self._split(rows[inside], cuts, gradient[inside], weight[inside])
                node[inside] = 2 * at + 1 + (rows[inside, feature[at]] > above[at])
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, weight, inner + 1)
        return Tree(feature, above, -self.rate * g / (h + self.least))

    def _split(self, rows, cuts, gradient, weight) -> tuple[int, float]:
        """Feature and threshold of the largest gain; nothing goes right without one."""
        best, found = 1e-9, (0, np.inf)
        g, h = gradient.sum(), weight.sum()
        whole = g * g / (h + self.least)
        for k, places in enumerate(cuts):
            right = rows[:, k, None] > places
            gr, hr = gradient @ right, weight @ right
            gain = gr**2 / (hr + self.least) + (g - gr) ** 2 / (h - hr + self.least) - whole
            if len(gain) and gain.max() > best:
                best, found = gain.max(), (k, float(places[gain.argmax()]))
        return found

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = np.full(len(rows), self.base)
        for tree in self.trees:
            raw += tree.of(rows)
        return 1 / (1 + np.exp(-raw))


def calibrated(wanted: np.ndarray, rows: np.ndarray, precision: float) -> float:
    """The least score from which on ``precision`` of the held-out rows are right.

    Rows, and the wanted of them, are counted by equal steps of the score. One
    wrong row is counted in addition, so few rows can't pass for certainty;
    infinite if no score will do.
    """
    right, all_rows = np.cumsum(wanted[::-1])[::-1], np.cumsum(rows[::-1])[::-1]
    good = np.flatnonzero((right >= precision * (all_rows + 1)) & (rows > 0))
    return float(good[0] / len(rows)) if len(good) else float("inf")

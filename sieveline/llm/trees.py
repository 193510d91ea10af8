"""Gradient-boosted regression trees over binned features, for a few thousand labelled rows."""

from __future__ import annotations

import numpy as np

BINS = 64


class BoostedTrees:
    """Least-squares boosting of shallow trees; missing values (NaN) go to the lowest bin."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, least: int = 5, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.penalty = rounds, depth, rate, least, penalty
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, bin and value of each node

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), side="left") for e, c in zip(self.edges, x.T)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c[~np.isnan(c)], np.linspace(0, 1, BINS)[1:-1])) if (~np.isnan(c)).any() else np.zeros(0) for c in x.T]
        self.base = float(y.mean())
        bins, guess = self._bin(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            tree = self._grow(bins, y - guess)
            if tree is None:
                break
            self.trees.append(tree)
            guess += self.rate * self._walk(tree, bins)
        return self

    def _grow(self, bins: np.ndarray, rest: np.ndarray) -> tuple | None:
        """One tree as a full binary tree in arrays; a leaf has feature -1."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        members = {0: np.arange(len(rest))}
        for node in range(size):
            if node not in members:
                continue
            own = members[node]
            value[node] = rest[own].sum() / (len(own) + self.penalty)
            if node >= 2**self.depth - 1 or len(own) < 2 * self.least:
                continue
            best, at = 1e-9, None
            whole = rest[own].sum() ** 2 / (len(own) + self.penalty)
            for f in range(bins.shape[1]):
                count = np.bincount(bins[own, f], minlength=BINS).cumsum()
                total = np.bincount(bins[own, f], rest[own], minlength=BINS).cumsum()
                left_n, right_n = count[:-1], count[-1] - count[:-1]
                gain = total[:-1] ** 2 / (left_n + self.penalty) + (total[-1] - total[:-1]) ** 2 / (right_n + self.penalty) - whole
                gain[(left_n < self.least) | (right_n < self.least)] = -1
                if gain.max(initial=-1) > best:
                    best, at = float(gain.max()), (f, int(gain.argmax()))
            if at:
                feature[node], cut[node] = at
                left = bins[own, at[0]] <= at[1]
                members[2 * node + 1], members[2 * node + 2] = own[left], own[~left]
        return (feature, cut, value) if feature[0] >= 0 else None

    def _walk(self, tree: tuple, bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(bins), int)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self._bin(x)
        return self.base + self.rate * sum((self._walk(t, bins) for t in self.trees), np.zeros(len(x)))


def isotonic(guess: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve nearest to truth over guess (pool adjacent violators)."""
    by = np.argsort(guess, kind="stable")
    blocks: list[list[float]] = []
    for g, t in zip(guess[by], truth[by]):
        blocks.append([t, 1.0, g])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n, (a[2] * a[1] + b[2] * b[1]) / n])
    knots = np.array(blocks)
    return knots[:, 2], knots[:, 0]

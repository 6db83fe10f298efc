"""Small randomised trees for groups that fit a task: a few hundred rows, scored out of fold."""

from __future__ import annotations

import numpy as np


class Trees:
    """Trees that split by the best of a few random thresholds at each node; all trees grow together, a level at a time."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, trees: int = 60, depth: int = 4, tries: int = 3):
        n, features = x.shape
        w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # classes weigh alike
        self.depth, self.splits = depth, []
        tree, at = np.arange(trees), np.zeros((n, trees), dtype=np.int64)
        up = np.broadcast_to((w * (y == 1))[:, None], at.shape)
        both = np.broadcast_to(w[:, None], at.shape)

        def sums(node: np.ndarray, width: int, what: np.ndarray) -> np.ndarray:
            return np.bincount((tree * width + node).ravel(), what.ravel(), trees * width).reshape(trees, width)

        for level in range(depth):
            width = 1 << level
            best = np.full((trees, width), np.inf)
            feature, edge = np.zeros((trees, width), dtype=np.int64), np.zeros((trees, width))
            for _ in range(tries):
                f = rng.integers(features, size=(trees, width))
                e = x[rng.integers(n, size=(trees, width)), f]
                right = x[np.arange(n)[:, None], f[tree, at]] > e[tree, at]
                p, a = sums(2 * at + right, 2 * width, up), sums(2 * at + right, 2 * width, both)
                impure = (p * (1 - p / np.maximum(a, 1e-300))).reshape(trees, width, 2).sum(axis=2)
                better = impure < best
                best, feature, edge = np.where(better, impure, best), np.where(better, f, feature), np.where(better, e, edge)
            self.splits.append((feature, edge))
            at = 2 * at + (x[np.arange(n)[:, None], feature[tree, at]] > edge[tree, at])
        leaves = 1 << depth
        a = sums(at, leaves, both)
        self.value = np.where(a > 0, sums(at, leaves, up) / np.maximum(a, 1e-300), 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        tree = np.arange(self.value.shape[0])
        at = np.zeros((len(x), len(tree)), dtype=np.int64)
        for feature, edge in self.splits:
            at = 2 * at + (x[np.arange(len(x))[:, None], feature[tree, at]] > edge[tree, at])
        return self.value[tree, at].mean(axis=1)


def area(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the curve by average ranks; 0.5 if a class is missing."""
    ones = int((y == 1).sum())
    if not ones or ones == len(y):
        return 0.5
    _, place, n = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[place]
    return float((ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)))


def out_of_fold_area(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, folds: int, **options) -> float:
    """Mean area over folds that are stretches of each class in turn; folds without one of the classes count as 0.5."""
    fold = np.zeros(len(y), dtype=int)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        fold[own] = np.arange(len(own)) * folds // max(1, len(own))
    areas = []
    for k in range(folds):
        held = fold == k
        if not held.any() or len(set(y[~held].tolist())) < 2:
            areas.append(0.5)
        else:
            areas.append(area(Trees(x[~held], y[~held], rng, **options).score(x[held]), y[held]))
    return float(np.mean(areas))

"""Bagged decision trees for two classes, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes as arrays: a leaf has feature -1. Rows with a value at or below the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int32)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)


def _split(x: np.ndarray, y: np.ndarray, w: np.ndarray, least: int, among: np.ndarray) -> tuple[int, float]:
    """The feature and threshold with the lowest weighted Gini impurity; feature -1 if none leaves ``least`` rows on both sides."""
    best, where = np.inf, (-1, 0.0)
    total, positive = w.sum(), (w * y).sum()
    base = positive * (total - positive) / total
    for f in among.tolist():
        order = np.argsort(x[:, f], kind="stable")
        v, cw, cp = x[order, f], np.cumsum(w[order]), np.cumsum((w * y)[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if not len(cut):
            continue
        lw, lp = cw[cut], cp[cut]
        rw, rp = total - lw, positive - lp
        score = lp * (lw - lp) / lw + rp * (rw - rp) / rw
        k = int(score.argmin())
        if score[k] < best:
            best, where = score[k], (f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return where if best < base - 1e-9 else (-1, 0.0)


def fit_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: int, rng: np.random.Generator, subset: int) -> Tree:
    nodes: list[list] = []

    def grow(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        share = float((w[rows] * y[rows]).sum() / w[rows].sum())
        nodes.append([-1, 0.0, 0, 0, share])
        if left and 0 < share < 1:
            f, t = _split(x[rows], y[rows], w[rows], least, rng.permutation(x.shape[1])[:subset])
            if f >= 0:
                go = x[rows, f] <= t
                nodes[me][:2] = f, t
                nodes[me][2] = grow(rows[go], left - 1)
                nodes[me][3] = grow(rows[~go], left - 1)
        return me

    grow(np.arange(len(y)), depth)
    cols = list(zip(*nodes, strict=True))
    return Tree(np.array(cols[0], np.int32), np.array(cols[1]), np.array(cols[2], np.int32), np.array(cols[3], np.int32), np.array(cols[4]))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 8, least: int = 2, subset: int = 6, seed: int = 7) -> list[Tree]:
    """Each tree on a bootstrap sample, each split among ``subset`` random features, so that no single feature decides in all
    trees; both classes weigh the same. One class only gives its constant."""
    rng = np.random.default_rng(seed)
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    if not len(y):
        return [Tree(np.array([-1], np.int32), np.zeros(1), np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1))]
    positive = y.mean()
    w = np.where(y > 0, 0.5 / max(positive, 1e-12), 0.5 / max(1 - positive, 1e-12))
    out = []
    for _ in range(trees):
        take = rng.integers(0, len(y), len(y))
        out.append(fit_tree(x[take], y[take], w[take], depth, least, rng, subset))
    return out


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """The mean share of class 1 over the trees."""
    x = np.asarray(x, np.float64)
    return sum(t.predict(x) for t in trees) / len(trees) if len(x) else np.zeros(0)

"""A small decision tree: grown on the driver from a bounded table, applied to arrays of rows."""

from __future__ import annotations

import numpy as np

#: Thresholds that a feature is tried at, at most: halfway between its values, or between as many quantiles of them.
CUTS = 4000


def _cuts(v: np.ndarray) -> np.ndarray:
    values = np.unique(v)
    if len(values) > CUTS + 1:
        values = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1), method="nearest"))
    return (values[1:].astype(np.float64) + values[:-1]) / 2


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, leaf: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, left, right, value): nodes of a binary tree by Gini impurity; feature -1 marks a leaf, value is its share of y.

    Features are cut into at most CUTS + 1 bins first, so that a node's splits are read off counts by bin.
    """
    cuts = [_cuts(x[:, f]) for f in range(x.shape[1])] if len(x) else []
    bins = [np.searchsorted(c, x[:, f]).astype(np.uint16) for f, c in enumerate(cuts)]  # bin k: above k cuts
    nodes: list[list] = []

    def node(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        share = float(y[rows].mean()) if len(rows) else 0.0
        nodes.append([-1, 0.0, -1, -1, share])
        if level >= depth or len(rows) < 2 * leaf or share in (0.0, 1.0):
            return at
        best = (1e-7, -1, 0)
        n, ones, total = len(rows), y[rows], y[rows].sum()
        whole = share * (1 - share)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = bins[f][rows]
            k = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            ok = (k >= leaf) & (n - k >= leaf)
            if not ok.any():
                continue
            s = np.cumsum(np.bincount(b, ones, len(c) + 1))[:-1]
            k, s = np.where(ok, k, 1), np.where(ok, s, 0)
            left, right = s / k, (total - s) / np.maximum(n - k, 1)
            gain = np.where(ok, whole - (k * left * (1 - left) + (n - k) * right * (1 - right)) / n, -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), f, i)
        if best[1] >= 0:
            less = bins[best[1]][rows] <= best[2]
            nodes[at][:2] = best[1], float(cuts[best[1]][best[2]])
            nodes[at][2] = node(rows[less], level + 1)
            nodes[at][3] = node(rows[~less], level + 1)
        return at

    node(np.arange(len(y)), 0)
    f, t, a, b, v = zip(*nodes)
    return np.array(f), np.array(t), np.array(a), np.array(b), np.array(v)


def apply(tree, x: np.ndarray) -> np.ndarray:
    """The leaf value of every row."""
    feature, threshold, left, right, value = tree
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return value[at]
        n = at[inner]
        at[inner] = np.where(x[inner, feature[n]] <= threshold[n], left[n], right[n])

"""Histogram gradient-boosted trees for two classes, in numpy.

Trees are complete binary trees of one depth, flattened into arrays, so a
batch of rows goes down all trees at once, by array indexing alone. Training is meant
for a bounded sample on the driver; the arrays are small and go to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Rows that go down the trees at a time.
ROWS = 512


@dataclass
class Trees:
    """``feature`` and ``cut`` of inner nodes by tree, ``leaf`` values, and the starting log-odds."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows; missing values count as 0."""
        x = np.nan_to_num(np.asarray(x, dtype=np.float64))
        out = np.full(len(x), self.start)
        if not len(x):
            return out
        trees, inner = self.feature.shape
        feature, cut, leaf = self.feature.ravel(), self.cut.ravel(), self.leaf.ravel()
        first, first_leaf = np.arange(trees) * inner, np.arange(trees) * (1 << self.depth)
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            own = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), dtype=np.int64)  # where each row is in each tree
            for _ in range(self.depth):
                place = first + node
                node = 2 * node + 1 + (part[own, feature[place]] > cut[place])
            out[at : at + ROWS] += leaf[first_leaf + node - inner].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 1.0
) -> Trees:
    """Fit by Newton steps on the logistic loss; ``least`` is the least curvature in a leaf.

    Without rows, or with one class, there are no trees and the probability is
    the share of the class, pulled to a half.
    """
    x = np.nan_to_num(np.asarray(x, dtype=np.float64))
    y = np.asarray(y, dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    start = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if len(y) < 2 or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), start, depth)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(n, start)
    all_f, all_c, all_l = [], [], []
    offset = np.arange(width) * bins
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            key = ((node - first) * width * bins)[:, None] + offset + binned
            gh = np.bincount(key.ravel(), np.repeat(g, width), nodes * width * bins).reshape(nodes, width, bins)
            hh = np.bincount(key.ravel(), np.repeat(h, width), nodes * width * bins).reshape(nodes, width, bins)
            gl, hl = gh.cumsum(2), hh.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0.0
            gain[:, :, -1] = 0.0
            best = gain.reshape(nodes, -1).argmax(1)
            worth = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            for k in np.nonzero(worth)[0]:
                f, b = divmod(int(best[k]), bins)
                feature[first + k] = f
                cut[first + k] = edges[f][b] if b < len(edges[f]) else np.inf
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        margin += leaf[at]
        all_f.append(feature)
        all_c.append(cut)
        all_l.append(leaf)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_l), start, depth)


def out_of_fold(x: np.ndarray, y: np.ndarray, folds: int = 3, **params) -> np.ndarray:
    """Margins of rows by trees fitted on the other folds; rows are dealt in turn within each class."""
    y = np.asarray(y)
    fold = np.empty(len(y), dtype=int)
    for c in np.unique(y):
        own = np.nonzero(y == c)[0]
        fold[own] = np.arange(len(own)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        if (fold == k).any():
            out[fold == k] = fit_trees(x[fold != k], y[fold != k], **params).margin(x[fold == k])
    return out


def isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising calibration by pooling adjacent violators.

    Blocks are joined by straight lines between their middles, and each block's
    share is pulled a little to its neighbours' whole, so that no block of a
    few rows says 0 or 1.
    """
    if not len(y):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, v in zip(np.asarray(margin)[order], np.asarray(y, dtype=float)[order], strict=True):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += t
    total = float(np.mean(y))
    at = np.array([t / n for s, n, t in blocks])
    share = np.array([(s + prior * total) / (n + prior) for s, n, t in blocks])
    return at, np.maximum.accumulate(share)


def calibrated(margin: np.ndarray, knots: tuple[np.ndarray, np.ndarray], keep: float = 0.02) -> np.ndarray:
    """Calibrated scores: the isotonic share, and with a weight of ``keep`` the raw probability, which keeps rows of one block in order."""
    raw = 1.0 / (1.0 + np.exp(-margin))
    return (1 - keep) * np.interp(margin, *knots) + keep * raw

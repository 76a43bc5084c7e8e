"""Gradient-boosted trees for a yes/no label, on histograms of binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete trees of one depth: a feature and a bin for each inner node, a value for each leaf."""

    cuts: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for k in range(x.shape[1]):
            out[:, k] = np.searchsorted(self.cuts[k], x[:, k], "left")
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.value.shape[1]))
        for t in range(len(self.value)):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (b[rows, self.feature[t, at]] > self.bin[t, at])
            out += self.value[t, at - (2**depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, ridge: float = 2.0) -> Trees:
    """Trees for labels 0 and 1 by second-order boosting of the logistic loss."""
    n, f = x.shape
    cuts = np.stack([np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(f)])
    p = np.clip(y.mean(), 0.01, 0.99)
    trees = Trees(cuts, np.zeros((rounds, 2**depth - 1), np.int64), np.full((rounds, 2**depth - 1), BINS, np.int64), np.zeros((rounds, 2**depth)), float(np.log(p / (1 - p))))
    b = trees.binned(x).astype(np.int64)
    cell = b + BINS * np.arange(f)
    logit = np.full(n, trees.start)
    for t in range(rounds):
        prob = 1 / (1 + np.exp(-logit))
        g, h = prob - y, prob * (1 - prob)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            flat = ((at - first)[:, None] * (f * BINS) + cell).ravel()
            gs, hs = (np.bincount(flat, np.repeat(v, f), width * f * BINS).reshape(width, f, BINS).cumsum(2) for v in (g, h))
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < 1) | (ha - hs < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            trees.feature[t, first : first + width] = np.where(good, best // BINS, 0)
            trees.bin[t, first : first + width] = np.where(good, best % BINS, BINS)
            at = 2 * at + 1 + (b[np.arange(n), trees.feature[t, at]] > trees.bin[t, at])
        leaf = at - (2**depth - 1)
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        trees.value[t] = -rate * gs / (hs + ridge)
        logit += trees.value[t, leaf]
    return trees

"""Gradient-boosted regression trees for a 0/1 label over a small dense matrix, and isotonic calibration; rows may have weights."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting over quantile bins; every tree is complete to ``depth`` and stored level by level."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Trees":
        weight = np.ones(len(y)) if weight is None else weight
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
        binned = self._bin(x)
        share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        self.feature = np.zeros((self.rounds, 2**self.depth - 1), np.int64)
        self.cut = np.full((self.rounds, 2**self.depth - 1), self.bins, np.int64)  # beyond all bins: everything goes left
        self.leaf = np.zeros((self.rounds, 2**self.depth))
        raw = np.full(len(y), self.start)
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                self._split(t, level, binned, node, g, h)
                at = 2**level - 1 + node
                node = 2 * node + (binned[np.arange(len(y)), self.feature[t, at]] > self.cut[t, at])
            top, low = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            self.leaf[t] = self.rate * top / (low + 1.0)
            raw += self.leaf[t][node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def _split(self, t: int, level: int, binned: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        nodes = 2**level
        best = np.full(nodes, 1e-6)
        for j in range(binned.shape[1]):
            key = node * self.bins + binned[:, j]
            gl = np.bincount(key, g, nodes * self.bins).reshape(nodes, -1).cumsum(1)
            hl = np.bincount(key, h, nodes * self.bins).reshape(nodes, -1).cumsum(1)
            gt, ht = gl[:, -1:], hl[:, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < self.least) | (ht - hl < self.least)] = 0
            cut = gain.argmax(1)
            top = gain[np.arange(nodes), cut]
            win = top > best
            best[win] = top[win]
            at = 2**level - 1 + np.flatnonzero(win)
            self.feature[t, at], self.cut[t, at] = j, cut[win]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for t in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (binned[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t][node]
        return out


class Isotonic:
    """Least-squares non-decreasing fit (pool adjacent violators), read with straight lines between its blocks."""

    def fit(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Isotonic":
        weight = np.ones(len(y)) if weight is None else weight
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, sum of raw values
        for value, label, w in zip(raw[order], y[order], weight[order], strict=True):
            blocks.append([float(label), float(w), float(w * value)])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                mean, more, total = blocks.pop()
                last = blocks[-1]
                last[0] = (last[0] * last[1] + mean * more) / (last[1] + more)
                last[1] += more
                last[2] += total
        self.x = np.array([total / w for _, w, total in blocks])
        # One row of either label in each block keeps the ends off 0 and 1.
        self.y = np.array([(mean * w + 0.5) / (w + 1) if w < 4 else mean for mean, w, _ in blocks])
        self.y = np.maximum.accumulate(self.y)
        return self

    def read(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)

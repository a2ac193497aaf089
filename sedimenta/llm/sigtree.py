"""Signature trees: nodes hold the OR of their records' token bitmaps and the range of their sizes.

A record's tokens are its sketch's lanes: lane i with value v is token (i, v). A node's bitmap has 16 bits per lane. Two
nodes can share at most as many lanes as their bitmaps meet in, which bounds the overlap of any two records below them;
a pair of nodes is pruned when that, or the ratio of their sizes, is too small. What is left at the leaves is compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sedimenta.llm.shingles import LANES, agreeing

LEAF, FANOUT = 32, 4
#: Pairs of records compared at once, few enough for a processor's cache.
AT_ONCE = 32_768


@dataclass
class Level:
    """One level of nodes, as arrays."""

    bitmaps: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _onehot(sketches: np.ndarray) -> np.ndarray:
    lanes = np.empty((len(sketches), LANES), np.uint16)
    words = sketches.view(np.uint64)
    for lane in range(LANES):
        value = (words[:, lane // 16] >> np.uint64(4 * (lane % 16))) & np.uint64(15)
        lanes[:, lane] = np.left_shift(np.uint16(1), value.astype(np.uint16))
    return lanes


class SignatureTree:
    """A tree over records that are first put in order of size and sketch, so that like records share leaves."""

    def __init__(self, sizes: np.ndarray, sketches: np.ndarray):
        keys = [sketches[:, w] for w in range(sketches.shape[1])]
        self.order = np.lexsort([*keys, np.log2(np.maximum(sizes, 1)).astype(np.int64)])
        self.sizes, self.sketches = sizes[self.order], sketches[self.order]
        starts = np.arange(0, len(sizes), LEAF)
        self.levels = [Level(np.bitwise_or.reduceat(_onehot(self.sketches), starts), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts))]
        while len(self.levels[-1].low) > 1:
            below = self.levels[-1]
            starts = np.arange(0, len(below.low), FANOUT)
            self.levels.append(Level(np.bitwise_or.reduceat(below.bitmaps, starts), np.minimum.reduceat(below.low, starts), np.maximum.reduceat(below.high, starts)))

    def pairs(self, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in the arrays given) of all pairs that agree in ``least`` lanes and whose sizes allow it."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            keep = np.minimum(level.high[a], level.high[b]) >= threshold * np.maximum(level.low[a], level.low[b])
            a, b = a[keep], b[keep]
            kept = [np.count_nonzero(level.bitmaps[a[i : i + 4096]] & level.bitmaps[b[i : i + 4096]], axis=1) >= least for i in range(0, len(a), 4096)]
            keep = np.concatenate(kept) if kept else np.zeros(0, bool)
            a, b = a[keep], b[keep]
            if depth:
                grid = np.arange(FANOUT)
                first = (a[:, None, None] * FANOUT + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
                second = (b[:, None, None] * FANOUT + grid[None, None, :] + 0 * grid[None, :, None]).ravel()
                many = len(self.levels[depth - 1].low)
                real = (first < many) & (second < many) & (first <= second)
                a, b = first[real], second[real]
        found_a, found_b = [], []
        grid, last, step = np.arange(LEAF), len(self.sizes), max(1, AT_ONCE // LEAF**2)
        for at in range(0, len(a), step):
            x, y = a[at : at + step, None, None] * LEAF, b[at : at + step, None, None] * LEAF
            i, j = np.broadcast_arrays(x + grid[:, None], y + grid)
            real = (i < j) & (j < last)
            i, j = i[real], j[real]
            near = alike(self.sizes, self.sketches, i, j, threshold, least)
            found_a.append(i[near]), found_b.append(j[near])
        if not found_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.order[np.concatenate(found_a)], self.order[np.concatenate(found_b)]


def alike(sizes: np.ndarray, sketches: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Whether records may be similar by their sizes and sketches."""
    a, b = sizes[i], sizes[j]
    good = np.minimum(a, b) >= threshold * np.maximum(a, b)
    sized = np.flatnonzero(good)
    good[sized] = agreeing(sketches[i[sized]], sketches[j[sized]]) >= least
    return good

"""Likeness of blocks of fingerprints, many pairs at once in numpy: the scores of `likeness`, to the last bit.

A bound on the score of all pairs of two blocks is two matrix products. One counts the bits that hashes share. The other bounds what histograms share: bins are cut into slices at a few levels,
the smaller of two slices is no more than the root of their product, and full and empty slices are exact. Only pairs whose bound reaches the threshold are compared bin by bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import numpy as np

#: Levels at which bins are cut, in multiples of the mean bin.
LEVELS = (2 / 3, 3 / 2)
#: Rows and columns of a tile: its products are used while they are near.
TILE = (512, 2048)
#: Pairs that are compared in single precision at once.
AT_ONCE = 1024


class Block:
    """Fingerprints of one length of histogram, with what bounds them. mean: a mean bin, the same for all blocks that are compared."""

    def __init__(self, ids: np.ndarray, hi: np.ndarray, lo: np.ndarray, histograms: np.ndarray, mean: float) -> None:
        self.ids, self.hi, self.lo, self.n = ids, hi.view(np.uint64), lo.view(np.uint64), len(ids)
        self.columns = np.ascontiguousarray(histograms.T)
        self.rows = histograms.astype(np.float32)
        self.odd = bool(np.isnan(histograms).any())
        self.wide = bool((self.hi >> np.uint64(32)).any() or (self.lo >> np.uint64(32)).any())
        edges = [0.0, *(mean * x for x in LEVELS), np.inf]
        with np.errstate(invalid="ignore", over="ignore"):
            parts = [np.clip(self.rows - np.float32(low), 0, np.float32(high) - np.float32(low)) for low, high in zip(edges, edges[1:], strict=False)]
            self.roots = np.sqrt(0.45 * np.concatenate(parts, axis=1)).astype(np.float32)

    def signs(self, wide: bool) -> np.ndarray:
        """The hash's bits as 1 and -1 (all 64 of each half where one has more than 32), scaled so that the product of two is their likeness of shape."""
        halves = np.stack([self.hi, self.lo], axis=1)
        halves = halves if wide else halves.astype(np.uint32)
        bits = np.unpackbits(halves.view(np.uint8).reshape(self.n, -1), axis=1)
        return (bits.astype(np.float32) * 2 - 1) * np.float32(np.sqrt(0.55 / 64))


def scores(a: Block, b: Block, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of the pairs (row p of a, row q of b), by the operations of `likeness` in their order. A bin that one histogram lacks counts as the other has it."""
    bits = np.bitwise_count(a.hi[p] ^ b.hi[q]).astype(np.int64) + np.bitwise_count(a.lo[p] ^ b.lo[q])
    least = np.fmin if a.odd or b.odd else np.minimum
    colors = np.zeros(len(p))
    for x, y in zip_longest(a.columns, b.columns):
        colors += y[q] if x is None else x[p] if y is None else least(x[p], y[q])
    return 0.55 * np.maximum(0.0, (1 - bits / 64 - 0.5) * 2) + 0.45 * colors


class Bounds:
    """Upper bounds on the scores of two blocks' pairs, tile by tile."""

    def __init__(self, a: Block, b: Block) -> None:
        self.a, self.b = a, b
        self.same = len(a.columns) == len(b.columns)
        wide = a.wide or b.wide
        self.signs = a.signs(wide), b.signs(wide)
        n = self.signs[0].shape[1]
        self.apart = np.float32(0.55 * (64 - n) / 64)
        self.steps = n + a.roots.shape[1] + 16
        self.room = [np.empty(TILE, np.float32) for _ in range(2)]

    def slack(self, threshold: np.ndarray | float) -> np.ndarray | float:
        """More than rounding to single precision can take off a bound near the threshold."""
        return 1.2e-7 * self.steps * (np.minimum(np.abs(threshold), 1e30) + 1.1)

    def pairs(self, threshold: np.ndarray | float, rows: slice, columns: slice) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of a tile whose bound reaches the threshold (one, or one a row); nothing is known of bins that aren't numbers, so these pairs stay."""
        a, b = self.a, self.b
        m, n = min(rows.stop, a.n) - rows.start, min(columns.stop, b.n) - columns.start
        if not self.same:
            p, q = (x.ravel() for x in np.indices((m, n)))
            return p + rows.start, q + columns.start
        shape, color = (x.ravel()[: m * n].reshape(m, n) for x in self.room)
        with np.errstate(invalid="ignore", over="ignore"):
            least = np.asarray(threshold - self.slack(threshold), np.float32)
            np.matmul(self.signs[0][rows], self.signs[1][columns].T, out=shape)
            if self.apart:
                shape += self.apart
            np.maximum(shape, 0, out=shape)
            np.matmul(a.roots[rows], b.roots[columns].T, out=color)
            shape += color
            p, q = np.divmod(np.flatnonzero(~(shape < (least[:, None] if least.ndim else least))), n)
        kept = self.likely(p, q, rows.start, columns.start, threshold)
        return p[kept] + rows.start, q[kept] + columns.start

    def likely(self, p: np.ndarray, q: np.ndarray, row: int, column: int, threshold: np.ndarray | float) -> np.ndarray:
        """Whether the score in single precision reaches the threshold, for pairs of a tile that starts at this row and column."""
        a, b = self.a, self.b
        kept = np.ones(len(p), bool)
        if a.odd or b.odd:
            return kept
        ones = np.full(len(a.columns), 0.45, np.float32)
        for at in range(0, len(p), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            i, j = p[some] + row, q[some] + column
            bits = np.bitwise_count(a.hi[i] ^ b.hi[j]) + np.bitwise_count(a.lo[i] ^ b.lo[j])
            t = threshold[p[some]] if np.ndim(threshold) else threshold
            with np.errstate(invalid="ignore", over="ignore"):
                about = np.minimum(a.rows.take(i, axis=0), b.rows.take(j, axis=0)) @ ones + 0.55 * np.maximum(0.0, 1 - bits / 32.0)
                kept[some] = ~(about < t - self.slack(t))
        return kept


def tiles(a: Block, b: Block) -> Iterator[tuple[slice, slice]]:
    for i in range(0, a.n, TILE[0]):
        for j in range(0, b.n, TILE[1]):
            yield slice(i, min(a.n, i + TILE[0])), slice(j, min(b.n, j + TILE[1]))


def near(a: Block, b: Block, threshold: float, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of a, row of b and score of all pairs that reach the threshold, in parts; if b is a itself, each pair once and no row with itself."""
    bounds = Bounds(a, b)
    for rows, columns in tiles(a, b):
        if itself and columns.stop <= rows.start + 1:
            continue
        p, q = bounds.pairs(threshold, rows, columns)
        if itself:
            p, q = p[p < q], q[p < q]
        score = scores(a, b, p, q)
        kept = score >= threshold if not (a.odd or b.odd) else ~(score < threshold)
        if kept.any():
            yield p[kept], q[kept], score[kept]


def no_scores(a: Block, k: int, threshold: float) -> np.ndarray:
    """What nearest() takes at first: k scores for each row, which found ones have to reach."""
    return np.full((a.n, k), threshold)


def nearest(a: Block, b: Block, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of a, row of b and score of pairs of other ids that reach the least of the k scores of their row in `best`, at most k a row: highest scores first, then first rows of b.

    `best` is brought up to date, so that what comes later has to reach it. What isn't a number counts as the highest score, as in SQL.
    """
    bounds, k = Bounds(a, b), best.shape[1]
    starts = [0, *((TILE[1] // 16, TILE[1] // 4) if best.min() == best.max() else ()), *range(TILE[1], b.n, TILE[1])]  # a few first, to know what is to be reached
    starts = [j for j in starts if j < b.n]
    out = []
    for i in range(0, a.n, TILE[0]):
        rows = slice(i, min(a.n, i + TILE[0]))
        known, own = best[rows].copy(), best[rows]
        held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for j, end in zip(starts, [*starts[1:], b.n], strict=True):
            least = own.min(axis=1)
            p, q = bounds.pairs(least, rows, slice(j, end))
            score = scores(a, b, p, q)
            kept = ~(score < least[p - i]) & (a.ids[p] != b.ids[q])
            if not kept.any():
                continue
            p, q, score = (np.concatenate([x, y[kept]]) for x, y in zip(held, (p, q, score), strict=True))
            key = np.where(np.isnan(score), np.inf, score)
            order = np.lexsort((q, -key, p))
            p, key = p[order], key[order]
            rank = np.arange(len(p)) - np.searchsorted(p, p)
            first = rank < k
            held = p[first], q[order][first], score[order][first]
            found = np.full(known.shape, -np.inf)
            found[p[first] - i, rank[first]] = key[first]
            own[:] = np.sort(np.concatenate([known, found], axis=1), axis=1)[:, k:]
        out.append(held)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))

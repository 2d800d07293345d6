"""An FM-index over a sequence of small integers, with batched searches."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """All suffixes of ``seq`` in order, by doubling; a suffix sorts before what extends it."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        later = np.zeros(n, np.int64)
        if step < n:
            later[: n - step] = rank[step:]
        both = rank * (n + 2) + later
        order = np.argsort(both, kind="stable")
        ordered = both[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1])))
        rank = fresh
        if rank[order[-1]] == n or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Bits of a sequence level by level, with prefix counts; ranks for arrays of queries."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.ones = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo


class FMIndex:
    """Backward search and location by sampled suffix positions."""

    def __init__(self, seq: np.ndarray, sigma: int, every: int = 8) -> None:
        """``seq`` has values in [0, sigma)."""
        self.n = n = len(seq) + 1  # with an end below all symbols
        full = np.concatenate((seq.astype(np.int64) + 1, [0]))
        order = suffix_array(full)
        self.bwt = full[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(full, minlength=sigma + 1))))
        self.tree = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        marked = order % every == 0
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.samples, self.marked = order[marked], marked

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that start with each row of ``patterns``."""
        count, width = patterns.shape
        lo, hi = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        live = np.arange(count)
        for j in range(width - 1, -1, -1):
            symbol = patterns[live, j].astype(np.int64) + 1
            a = self.first[symbol] + self.tree.rank(symbol, lo[live])
            b = self.first[symbol] + self.tree.rank(symbol, hi[live])
            lo[live], hi[live] = a, np.maximum(a, b)
            live = live[b > a]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffix rows, walking to the next sampled one."""
        rows, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[rows])
        while len(todo):
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.first[symbol] + self.tree.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.marked[rows[todo]]]
        return self.samples[self.marks[rows]] + steps

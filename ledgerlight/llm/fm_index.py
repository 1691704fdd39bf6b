"""A full-text index of a sequence of small numbers: suffix order, wavelet ranks, sampled positions.

The text is an array of symbols from 1 up, with 0 between stretches that no phrase may span. Many
phrases are searched at once, one array step per symbol from the last to the first.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by doubling the compared length each round."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < n:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


class WaveletRanks:
    """Number of occurrences of a symbol before a position, by one bit array per binary digit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.before = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.before.append(np.r_[0, np.cumsum(bit == 0)].astype(np.int32))
            self.zeros.append(int((bit == 0).sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(position), position.copy()
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            zero_start, zero_end = self.before[i][start], self.before[i][end]
            start = np.where(one, self.zeros[i] + start - zero_start, zero_start)
            end = np.where(one, self.zeros[i] + end - zero_end, zero_end)
        return end - start


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = 8):
        """``text`` holds symbols >= 0; it is closed with a smallest symbol of its own."""
        closed = np.r_[text.astype(np.int64) + 1, 0]
        order = suffix_order(closed)
        last = closed[order - 1]
        self.n, self.sample = len(closed), sample
        self.top = int(closed.max()) + 1
        self.before = np.searchsorted(np.sort(closed), np.arange(self.top + 1))
        self.ranks = WaveletRanks(last, max(1, int(self.top).bit_length()))
        self.last = last
        marked = order % sample == 0
        self.marked, self.mark_rank = marked, np.r_[0, np.cumsum(marked)]
        self.positions = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range [low, high) of suffixes that begin with each row of ``phrases``."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for symbol in phrases.T[::-1].astype(np.int64) + 1:
            here = np.minimum(symbol, self.top - 1)
            begin = self.before[here]
            low, high = begin + self.ranks.rank(here, low), begin + self.ranks.rank(here, high)
            high = np.where(symbol < self.top, high, low)
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix: step back to a sampled one, counting the steps."""
        rows, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[rows])
        while len(todo):
            symbol = self.last[rows[todo]]
            rows[todo] = self.before[symbol] + self.ranks.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.marked[rows[todo]]]
        return self.positions[self.mark_rank[rows]] + steps

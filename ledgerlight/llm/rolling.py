"""Prefix polynomial hashes of byte strings, modulo 2**64, as numpy arrays."""

from __future__ import annotations

import numpy as np

from ledgerlight.llm import worker

#: Odd multiplier, so that its powers can be divided out again. A fixed value.
BASE = 0x9E3779B97F4A7C15
_WORD = 1 << 64


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1)."""
    remembered = worker.table("powers")
    known = remembered.get(base)
    if known is None or len(known) < n:
        known, k = np.ones(max(n, 1 << 16), np.uint64), 1
        while k < len(known):
            m = min(k, len(known) - k)
            known[k : k + m] = known[:m] * np.uint64(pow(base, k, _WORD))
            k += m
        remembered[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the hash over all bits; one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PrefixHashes:
    """Hash of any substring [start, end) of ``data`` from two prefix hashes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data = data
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.prefix[1:])
        self.inverse = powers(pow(BASE, -1, _WORD), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k bytes from each position that has as many."""
        n = len(self.data) - k + 1
        return (self.prefix[k:] - self.prefix[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)

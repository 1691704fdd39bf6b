"""Sorting suffixes by comparing hashes.

Two suffixes are compared by finding their common extension: prefix polynomial hashes tell in one
step whether the next m bytes agree, so a binary search over m takes a number of steps logarithmic
in the compared length, and the byte after the extension decides. A bottom-up mergesort uses that
comparison; its runs start from suffixes that are already in order by their first sixteen bytes. All
comparisons of a step are done as arrays. Neighbours that hashes call equal are compared byte by
byte at the end, and a stretch in which one fails is sorted again by its bytes.
"""

from __future__ import annotations

import numpy as np

from ledgerlight.llm.arrow_text import ragged
from ledgerlight.llm.rolling import PrefixHashes

HEAD = 16


class Suffixes:
    """Suffixes [start, start + length) of a text; every length is at least ``HEAD``."""

    def __init__(self, text: PrefixHashes, starts: np.ndarray, lengths: np.ndarray):
        self.text, self.starts, self.lengths = text, starts.astype(np.int64), lengths.astype(np.int64)
        self.before, self.scale = text.prefix[self.starts], text.inverse[self.starts]

    def agree(self, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Do the first m bytes of suffixes a and b have the same hash?"""
        p = self.text.prefix
        return (p[self.starts[a] + m] - self.before[a]) * self.scale[a] == (p[self.starts[b] + m] - self.before[b]) * self.scale[b]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.lengths[a], self.lengths[b])
        whole = self.agree(a, b, high)
        low[whole] = high[whole]
        todo = np.flatnonzero(~whole)
        high[todo] -= 1
        while len(todo):
            middle = (low[todo] + high[todo] + 1) >> 1
            same = self.agree(a[todo], b[todo], middle)
            low[todo] = np.where(same, middle, low[todo])
            high[todo] = np.where(same, high[todo], middle - 1)
            todo = todo[low[todo] < high[todo]]
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is suffix a before suffix b? A prefix of another comes first."""
        common = self.extension(a, b)
        ends = (common == self.lengths[a]) | (common == self.lengths[b])
        data, last = self.text.data, len(self.text.data) - 1
        x, y = data[np.minimum(self.starts[a] + common, last)], data[np.minimum(self.starts[b] + common, last)]
        return np.where(ends, self.lengths[a] < self.lengths[b], x < y)

    def _heads(self) -> list[np.ndarray]:
        """The first sixteen bytes as two big-endian numbers."""
        data = np.ascontiguousarray(self.text.data)
        words = np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))
        return [words[self.starts].astype(np.uint64), words[self.starts + 8].astype(np.uint64)]

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order, and for each place whether that suffix equals the one before it."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        high, low = self._heads()
        order = np.lexsort((low, high))
        ties = np.r_[False, (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])]
        group_start = np.flatnonzero(~ties)
        size = np.diff(np.r_[group_start, n])
        run = 1
        while True:
            chosen = size > run
            if not chosen.any():
                break
            self._merge(order, group_start[chosen], size[chosen], run)
            run *= 2
        equal = np.zeros(n, bool)
        at = np.flatnonzero(ties)
        a, b = order[at - 1], order[at]
        same = self.lengths[a] == self.lengths[b]
        at, a, b = at[same], a[same], b[same]
        at = at[self.agree(a, b, self.lengths[a])]
        equal[at] = True
        wrong = at[~self._same_bytes(order[at - 1], order[at])]
        if len(wrong):
            self._sort_bytes(order, equal, group_start, size, wrong)
        return order, equal

    def _merge(self, order: np.ndarray, start: np.ndarray, size: np.ndarray, run: int) -> None:
        """Merge neighbouring runs of ``run`` places inside each group."""
        place = ragged(start, size)
        base = np.repeat(start, size)
        offset, limit = place - base, np.repeat(size, size)
        own = offset // run
        left = (own & 1) == 0
        other = np.minimum(np.where(left, own + 1, own - 1) * run, limit)
        count = np.minimum(other + run, limit) - other
        low, high = np.zeros(len(place), np.int64), count
        todo = np.flatnonzero(high > 0)
        mine = order[place]
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            there = order[base[todo] + other[todo] + middle]
            here = mine[todo]
            # From the left run count what is smaller, from the right run what is not larger.
            is_left = left[todo]
            first, second = np.where(is_left, there, here), np.where(is_left, here, there)
            smaller = self.less(first, second)
            down = np.where(is_left, smaller, ~smaller)
            low[todo] = np.where(down, middle + 1, low[todo])
            high[todo] = np.where(down, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        order[base + (own & ~1) * run + (offset - own * run) + low] = mine

    def _same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = np.ones(len(a), bool)
        for at in range(0, len(a), 50_000):
            x, y = a[at : at + 50_000], b[at : at + 50_000]
            n = self.lengths[x]
            differ = self.text.data[ragged(self.starts[x], n)] != self.text.data[ragged(self.starts[y], n)]
            same[at : at + 50_000] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
        return same

    def _sort_bytes(self, order, equal, group_start, size, wrong) -> None:
        raw = self.text.data.tobytes()
        for g in np.unique(np.searchsorted(group_start, wrong, side="right") - 1).tolist():
            a, b = int(group_start[g]), int(group_start[g] + size[g])
            key = {int(i): raw[self.starts[i] : self.starts[i] + self.lengths[i]] for i in order[a:b]}
            order[a:b] = sorted(order[a:b].tolist(), key=key.get)
            equal[a + 1 : b] = [key[int(x)] == key[int(y)] for x, y in zip(order[a : b - 1], order[a + 1 : b])]


def first_owner(text: PrefixHashes, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix its class of equal suffixes, and by class the smallest owner."""
    order, equal = Suffixes(text, starts, lengths).order()
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(~equal)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(~equal) - 1
    return kind, np.minimum.reduceat(owner[order], heads)

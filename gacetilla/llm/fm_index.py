"""FM-index over small symbols (one byte each) of one shard of text.

The suffix order is built by sorting the first eight symbols packed in one
integer and then doubling the compared length for suffixes that are still
tied; the Burrows-Wheeler transform is kept in a wavelet matrix of eight
packed bit levels with block counts.  ``count`` runs backward search for many
phrases at once, ``locate`` walks to sampled suffix positions.

Symbol 0 separates texts and must end the shard; phrases hold no 0.  Every
text start is sampled, so a walk never leaves its text.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class _Bits:
    """Bit vector with rank: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray):
        size = (len(bits) >> 6) + 1
        packed = np.zeros(size * 8, dtype=np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[:len(some)] = some
        self.words = packed.view(np.uint64)
        self.before = np.zeros(size + 1, dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & _ONE == 1


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` (uint8) in the order of their suffixes."""
    n = len(s)
    key = np.zeros(n + 8, dtype=np.uint64)
    key[:n] = s
    for width in (1, 2, 4):
        key[:n + 8 - width] = (key[:n + 8 - width] << np.uint64(8 * width)) | key[width:]
    key = key[:n]
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, dtype=bool)
    head[1:] = key[1:] != key[:-1]
    del key
    at = np.flatnonzero(head)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    reach = 8
    size = np.diff(np.append(at, n))
    tied = np.flatnonzero(np.repeat(size > 1, size))
    while len(tied):
        pos = order[tied]
        # what stands past the end is smaller than any symbol, the shorter suffix first
        later = np.where(pos + reach < n, rank[np.minimum(pos + reach, n - 1)], n - 1 - pos - reach)
        pair = rank[pos] * np.int64(n + reach + 1) + later + reach
        by = np.argsort(pair)
        pos, pair = pos[by], pair[by]
        order[tied] = pos
        head = np.ones(len(tied), dtype=bool)
        head[1:] = pair[1:] != pair[:-1]
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(tied)))
        # a group keeps its place: its rank is the place of its first suffix
        rank[pos] = np.repeat(tied[at], size)
        tied = tied[np.repeat(size > 1, size)]
        reach *= 2
    return order


class FMIndex:
    def __init__(self, s: np.ndarray, every: int = 8):
        n = self.n = len(s)
        order = suffix_order(s)
        # symbols before each suffix; none before the first position
        bwt = s[order - 1]
        bwt[order == 0] = 0
        self.smaller = np.zeros(257, dtype=np.int64)
        np.cumsum(np.bincount(s, minlength=256), out=self.smaller[1:])
        marked = (order % every == 0) | (bwt == 0)
        self.marked = _Bits(marked)
        self.sample = order[marked].astype(np.int32)
        self.levels, self.zeros = [], []
        cur = bwt
        for bit in range(7, -1, -1):
            one = (cur >> np.uint8(bit)) & np.uint8(1) == 1
            self.levels.append(_Bits(one))
            zeros, ones = cur[~one], cur[one]
            self.zeros.append(len(zeros))
            cur = np.concatenate([zeros, ones])
        every_symbol = np.arange(256)
        self.begin = np.zeros(256, dtype=np.int64)
        self.begin = self._down(every_symbol, np.zeros(256, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            i = np.where((c >> (7 - level)) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times that symbol c comes before row i of the transform."""
        return self._down(c, i) - self.begin[c]

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the phrases (rows of equal length)."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j].astype(np.int64)
            lo[live] = self.smaller[c] + self.rank(c, lo[live])
            hi[live] = self.smaller[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        dead = lo >= hi
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out = np.empty(len(rows), dtype=np.int64)
        at, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(at):
            there = self.marked.get(row)
            out[at[there]] = self.sample[self.marked.rank(row[there])] + steps
            at, row = at[~there], row[~there]
            c, i = np.zeros(len(row), dtype=np.int64), row
            for bits, zeros in zip(self.levels, self.zeros):
                one = bits.get(i)
                ones = bits.rank(i)
                c = c * 2 + one
                i = np.where(one, zeros + ones, i - ones)
            row = self.smaller[c] + i - self.begin[c]
            steps += 1
        return out

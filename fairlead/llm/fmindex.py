"""An FM-index over a shard of training text, with words as symbols.

The shard is a sequence of word numbers in segments; each segment ends with a border (symbol 0) that no phrase
holds. Suffixes are sorted by prefix doubling; two borders differ by their place, so suffixes are compared up
to the end of their segment only. The last column is kept as a wavelet tree, level by level, with a running
count per 64 bits. Positions are sampled; a row is located by walking back to a sampled one.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def sort_suffixes(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of ``text``, whose last symbol is a border."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the border
    width = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, np.int64)])
    for i in range(width):
        key <<= bits
        np.add(key, padded[i : i + n], out=key, where=left >= i)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(n, bool)
    # A suffix whose border is within the first symbols is told from its like by its place.
    new[1:] = (ordered[1:] != ordered[:-1]) | (left[order[1:]] < width)
    rank = np.empty(n + 1, np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order], rank[n] = first, -1
    size = width
    tied = ~new
    tied[:-1] |= ~new[1:]
    rows = np.flatnonzero(tied)
    while len(rows):
        at = order[rows]
        follow = rank[np.minimum(at + size, n)]
        by = np.lexsort((follow, rank[at]))
        at, follow = at[by], follow[by]
        order[rows] = at
        was = rank[at]
        new = np.ones(len(rows), bool)
        new[1:] = (was[1:] != was[:-1]) | (follow[1:] != follow[:-1])
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = rows[tied]
        size *= 2
    return order


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // 64 + 1
        padded = np.zeros(blocks * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate([[0], counts[:-1]])
        self.zeros = len(bits) - int(counts[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """Symbols of a sequence, one level per bit from the highest; zeros go left on every level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.bits = [], bits
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b & 1).astype(bool)
            self.levels.append(Bits(ones))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _down(self, level: Bits, one: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = level.ones(at)
        return np.where(one, level.zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        start = np.zeros_like(at)
        for i, level in enumerate(self.levels):
            one = symbol >> (self.bits - 1 - i) & 1 != 0
            start, at = self._down(level, one, start), self._down(level, one, at)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for level in self.levels:
            one = level.get(at)
            symbol = symbol << 1 | one
            start, at = self._down(level, one, start), self._down(level, one, at)
        return symbol, at - start


class FmIndex:
    """Counts and locates phrases in one shard. ``text``: symbols below 2**bits, 0 at the end of each segment."""

    def __init__(self, text: np.ndarray, bits: int):
        self.n = len(text)
        if not self.n:
            return
        order = sort_suffixes(text, bits)
        last = text[order - 1]  # what stands before each suffix; the text's last border before its first
        self.tree = WaveletTree(last.astype(np.int64), bits)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        sampled = (order % SAMPLE_EVERY == 0) | (last == 0)
        self.sampled, self.places = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: first and end row of each phrase (rows of ``phrases``, the words at the left)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        if not self.n:
            return low, low
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            live = live[(sizes[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = phrases[live, sizes[live] - 1 - step]
            base = self.smaller[symbol]
            low[live], high[live] = base + self.tree.rank(symbol, low[live]), base + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            here = rows[live]
            done = self.sampled.get(here)
            out[live[done]] = self.places[self.sampled.ones(here[done])] + steps[live[done]]
            live, here = live[~done], here[~done]
            symbol, before = self.tree.access(here)
            rows[live] = self.smaller[symbol] + before
            steps[live] += 1
        return out

"""Words of whole Arrow text columns, found and hashed with array operations inside a task.

Texts stay UTF-8 bytes. A-Z are lower-cased; other letters are left as they are. Words are runs of bytes of
a class, which equals the same class over code points as long as it holds all or no bytes from 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer text is worked on alone and takes about 40 times its size in memory.
CHUNK_BYTES = 1 << 20

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _GAMMA)

#: Everything but space and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name]


@dataclass
class Words:
    """Words of the documents lo to hi: document (from 0 at lo), first byte and end byte in ``text``."""

    text: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        n = len(self.text) + 1
        sums = np.zeros(n, np.uint64)
        np.cumsum(BYTE_CODES[self.text] * _power_table("up", _BASE, n)[: n - 1], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * _power_table("down", pow(_BASE, -1, 1 << 64), n)[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64) * _GAMMA)

    def prefix_hashes(self, size: int) -> np.ndarray:
        """The hash of each word's first ``size`` bytes (of all of it where it is shorter)."""
        short = Words(self.text, self.doc, self.start, np.minimum(self.end, self.start + size))
        return mix(short.hashes() + np.uint64(size))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one row alone."""
    limit = limit or CHUNK_BYTES
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, inside: np.ndarray = NOT_SPACE) -> Words:
    """The words of rows lo to hi, in order; a word never crosses a row."""
    a, b = int(offsets[lo]), int(offsets[hi])
    text = LOWER[data[a:b]]
    at = offsets[lo : hi + 1] - a
    border = np.zeros(len(text) + 1, bool)
    border[at] = True
    is_word = inside[text]
    before = np.zeros_like(is_word)
    before[1:] = is_word[:-1]
    after = np.zeros_like(is_word)
    after[:-1] = is_word[1:]
    start = np.flatnonzero(is_word & (~before | border[:-1]))
    end = np.flatnonzero(is_word & (~after | border[1:])) + 1
    return Words(text, np.searchsorted(at, start, side="right") - 1, start, end)


def per_document(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by document, in the type of ``values``."""
    out = np.zeros(n, values.dtype)
    np.add.at(out, doc, values)
    return out


class HashTable:
    """Numbers of known 64-bit hashes, looked up for whole arrays at once."""

    SIZE = 1 << 20

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.concatenate([np.zeros(1, np.uint64), hashes.astype(np.uint64)])
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left, salt = np.arange(1, len(self.hashes)), 0
        while len(left):  # what finds its place taken goes to a further table
            salt += 1
            key = np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
            table = np.zeros(self.SIZE, np.int32)
            at = self._at(self.hashes[left], key)
            table[at] = left
            self.tables.append((key, table))
            left = left[table[at] != left]

    def _at(self, hashes: np.ndarray, key: np.uint64) -> np.ndarray:
        return (hashes * key >> np.uint64(44)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the known ones, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        rest = None
        for key, table in self.tables:
            some = hashes if rest is None else hashes[rest]
            got = table[self._at(some, key)]
            good = (got > 0) & (self.hashes[got] == some)
            if rest is None:
                out[good] = got[good] - 1
                rest = np.flatnonzero(~good & (got > 0))
            else:
                out[rest[good]] = got[good] - 1
                rest = rest[~good & (got > 0)]
        return out


def take_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The byte strings from start to end as an Arrow column."""
    sizes = end - start
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    flat = data[np.repeat(start - ends + sizes, sizes) + np.arange(total)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])

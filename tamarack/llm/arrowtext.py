"""Vectorised word and word-window hashing over Arrow string columns.

A batch of texts is one byte buffer plus offsets. Words are found by a 256-entry separator table, every word
gets a 64-bit polynomial hash from prefix sums, and every window of n words a second one on top. No Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once: keeps the working arrays of a task below 100 MB.
CHUNK_BYTES = 1 << 19

#: Multipliers of the polynomials (any odd 64-bit numbers).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags: True for the bytes in the given inclusive ranges."""
    flags = np.zeros(256, bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


#: Words are maximal runs of anything but ASCII white space.
WHITESPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are maximal runs of ASCII letters and digits and of everything outside ASCII.
NON_ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Byte folding that lower-cases A-Z only.
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below size."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As _powers, sizes rounded up to a power of two so that few tables are kept."""
    return _powers(base, 1 << max(16, size.bit_length()))


@lru_cache(maxsize=4)
def _byte_table(fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))
    return table[LOWER_ASCII] if fold else table


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `most` bytes, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


class Words:
    """The words of rows [a, b): byte spans, 64-bit hashes, and the first word of each row (n+1 numbers)."""

    def __init__(self, data, offsets, a, b, sep=WHITESPACE, fold=False):
        low, high = int(offsets[a]), int(offsets[b])
        data, bounds = data[low:high], offsets[a : b + 1] - low
        n = len(data)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self._total, self._inverse = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(b - a + 1, np.int64)
            return
        inside = ~sep[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        power, inverse = powers(BYTE_BASE, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_table(fold)[data] * power[:n], out=total[1:])
        self._total, self._inverse = total, inverse
        self.hashes = self._spans(self.ends)
        self.first = np.searchsorted(self.starts, bounds)

    def _spans(self, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each word's start to the given ends."""
        h = (self._total[ends] - self._total[self.starts]) * self._inverse[self.starts]
        return mix(h + (ends - self.starts).astype(np.uint64) * np.uint64(WORD_BASES[0]))

    def prefixes(self, size: int) -> np.ndarray:
        """A hash for each word's first `size` bytes (the whole word if it is shorter)."""
        return self._spans(np.minimum(self.starts + size, self.ends))

    def windows(self, size: int, which: int = 0) -> np.ndarray:
        """A hash for each window of `size` words by its first word; windows may cross rows (see inside())."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, np.uint64)
        power, inverse = powers(WORD_BASES[which], n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * power[:n], out=total[1:])
        return mix((total[size:] - total[:-size]) * inverse[: n - size + 1])

    def limit(self) -> np.ndarray:
        """For each word, the index after the last word of its row."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def begin(self) -> np.ndarray:
        """For each word, the index of the first word of its row."""
        return np.repeat(self.first[:-1], np.diff(self.first))

    def inside(self, size: int) -> np.ndarray:
        """Whether the window that starts at each of the first n-size+1 words lies in one row."""
        n = len(self.hashes) - size + 1
        return np.arange(size, size + n) <= self.limit()[:n] if n > 0 else np.zeros(0, bool)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every row's word n-grams, row by row, and the first of each row (n+1 numbers).

        A row of fewer words, but not none, has one: all its words.
        """
        n = len(self.hashes)
        power, inverse = powers(WORD_BASES[0], n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * power[:n], out=total[1:])
        at, limit, begin = np.arange(n), self.limit(), self.begin()
        at = at[(at + size <= limit) | (at == begin)]
        end = np.minimum(at + size, limit[at]) if n else at
        h = (total[end] - total[at]) * inverse[at]
        return mix(h + (end - at).astype(np.uint64) * np.uint64(BYTE_BASE)), np.searchsorted(at, self.first)

"""Words and hashes of whole Arrow batches of texts, as NumPy arrays.

Words are the maximal runs of bytes outside ``\x20`` and ``\x09-\x0D``; all of these are
single bytes in UTF-8, so texts are cut as bytes and never decoded.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _random_words(name: str, n: int) -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(name.encode()).digest(8 * n), np.uint64)


_BYTE = _random_words("byte", 256)
_BASE = int(_random_words("base", 1)[0] | np.uint64(1))
_SLOT = _random_words("slot", 64) | np.uint64(1)


def release() -> None:
    """Give memory that a finished task has freed back to the system.

    Spark keeps Python workers for later tasks; what they hold on to would be missing to the executor.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the public splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of one piece: byte spans, and the first word of each row in ``bounds``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, other: np.ndarray = _SPACE) -> None:
        self.data = _LOWER[data] if lower else data
        inside = ~other[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from all its bytes and its length."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        length = self.ends - self.starts
        power = np.full(int(length.max()), _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        at = np.flatnonzero(self.inside)
        values = _BYTE[self.data[at]]
        begin = np.cumsum(length) - length
        values *= power[np.arange(len(at)) - np.repeat(begin, length)]
        return mix(np.add.reduceat(values, begin) + length.astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; rows are not looked at."""
    n = max(len(words) - size + 1, 0)
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += words[j : j + n] * _SLOT[j]
    return mix(total)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows one after another, first shingle of each row).

    A row with fewer words than ``size`` has its whole sequence as one shingle, one without
    words has none.
    """
    hashes = words.hashes()
    windows = window_hashes(hashes, size)
    out, bounds = [], [0]
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        if b - a >= size:
            found = np.sort(windows[a : b - size + 1])
            found = found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif b > a:
            found = window_hashes(hashes[a:b], int(b - a))
        else:
            found = hashes[:0]
        out.append(found)
        bounds.append(bounds[-1] + len(found))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(bounds)

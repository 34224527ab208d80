"""Vectorised work on Arrow string columns inside tasks: words, hashes, shingles.

The UTF-8 buffer of a column is cut into pieces of a bounded number of bytes
(one document at least), so memory doesn't grow with the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised pass takes, unless a single document has more.
PIECE_BYTES = 1 << 19
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE_BYTES)
            up, down = np.full(size, _ODD), np.full(size, _ODD_INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, which gives freed memory back when its task ends: workers stay for later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def row_pieces(ends: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    at, last = 0, len(ends) - 1
    while at < last:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, min(to, last)
        at = min(to, last)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data``, from one running sum over the buffer."""
    up, down = _POWERS.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[: len(data)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * down[starts]
    return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words (runs without ASCII white space).

    ``rows`` are the row offsets within ``data``, from 0 to its length.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~WHITE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~solid[:-1]
    edge[rows] = True
    starts = np.flatnonzero(solid & edge[:-1])
    edge[:-1] = ~solid
    edge[rows] = True
    edge[-1] = True
    ends = np.flatnonzero(solid & edge[1:]) + 1
    return starts, ends, np.searchsorted(rows, starts, "right") - 1


def window_hashes(words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside one row, and the first word's index."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(n, np.uint64)
    factor = 1
    for i in range(k):
        factor = factor * 0xC2B2AE3D27D4EB4F % (1 << 64) | 1
        sums += words[i : i + n] * np.uint64(factor)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(sums[at]), at


def distinct_shingles(data: np.ndarray, rows: np.ndarray, k: int = 3) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word windows (A-Z lower-cased).

    A row with fewer than k words has its whole sequence as the one shingle; a
    row without words has none.
    """
    data = LOWER[data]
    starts, ends, owner = word_spans(data, rows)
    words = span_hashes(data, starts, ends)
    hashes, at = window_hashes(words, owner, k)
    n = len(rows) - 1
    first = np.searchsorted(owner, np.arange(n + 1))
    cut = np.searchsorted(at, first)
    sets = []
    for i in range(n):
        if first[i + 1] - first[i] >= k:
            own = np.sort(hashes[cut[i] : cut[i + 1]])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif first[i + 1] > first[i]:
            few = words[first[i] : first[i + 1]]
            sets.append(mix(np.sum(few * np.arange(3, 3 + 2 * len(few), 2, dtype=np.uint64), keepdims=True) + np.uint64(len(few))))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets

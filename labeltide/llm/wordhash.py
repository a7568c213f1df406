"""64-bit hashes of the words and word shingles of a batch of texts, without a Python loop over words.

Words are runs of bytes other than space and the controls 9 to 13, with A-Z
lowered.  The hash of a word is a polynomial over a random value per byte,
taken as a difference of running sums, so a whole chunk of documents is
hashed by a few array operations.  Chunks hold about ``CHUNK_BYTES`` of text
and at least one document, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_M64 = (1 << 64) - 1
_GOLD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = x + np.uint64(_GOLD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint64)
    lower = np.where((codes >= 65) & (codes <= 90), codes + np.uint64(32), codes)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return mix(lower * np.uint64(0x100000001B3)), space


class WordHasher:
    """Holds the power tables; make one per task."""

    def __init__(self):
        self.value, self.space = _byte_tables()
        self._grow(CHUNK_BYTES * 2)

    def _grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.power, self.inverse = powers(_BASE), powers(_INVERSE)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start byte, end byte) of each word and, per document, the bounds of its words.

        ``data`` holds the documents' bytes; document i is ``data[offsets[i]:offsets[i + 1]]``,
        with ``offsets[0]`` 0 and ``offsets[-1]`` the length.
        """
        n = len(data)
        if n >= len(self.power):
            self._grow(2 * n)
        solid = ~self.space[data]
        first, last = solid.copy(), solid.copy()
        if n:
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            filled = offsets[:-1] < offsets[1:]
            head, tail = offsets[:-1][filled], offsets[1:][filled] - 1
            first[head] = solid[head]
            last[tail] = solid[tail]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.power[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverse[starts])
        return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's ``size``-word shingles, in order, and per document their bounds.

    A document of 1 to ``size`` - 1 words has its whole sequence as its only shingle.
    """
    counts = np.diff(bounds)
    n_out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n_out)))
    doc = np.repeat(np.arange(len(counts)), n_out)
    at = np.arange(out_bounds[-1]) - out_bounds[doc] + bounds[doc]
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        factor = np.uint64(pow(_GOLD, k + 1, 1 << 64) | 1)
        pos = at + k
        inside = pos < bounds[doc + 1]
        if inside.all():
            total += words[pos] * factor
        else:
            total[inside] += words[pos[inside]] * factor
    return mix(total), out_bounds


def distinct_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct values, concatenated, and their bounds."""
    flat = values.copy()
    for a, b in zip(bounds[:-1], bounds[1:]):
        flat[a:b].sort()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[bounds[:-1][bounds[:-1] < len(flat)]] = True
    before = np.concatenate(([0], np.cumsum(new)))
    return flat[new], before[bounds]


def text_chunks(column: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        end = min(len(column), max(end, row + 1))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end

"""Texts of Arrow batches as flat numpy arrays: bytes, words and word hashes.

All text operators that leave the JVM share these helpers, so that a batch is
worked on as a few long arrays instead of many Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lodestone.operators.durable import in_small_batches  # noqa: F401 - for the operators on texts

#: Bytes of text that are held as arrays at once; a longer text stands alone.
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODE_WORDS = np.where(SPACES, np.uint64(0), _BYTE_CODE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows into pieces of about ``limit`` bytes of text."""
    _, at = text_bytes(batch.column(text))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


class Words:
    """The words of a batch: ``start`` and ``end`` byte positions, and ``first[d]``,
    the index of the first word of row d (n+1 entries)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> None:
        solid = ~gaps[raw]
        n = len(raw)
        begins, ends = solid.copy(), solid.copy()
        if n:
            begins[1:] &= ~solid[:-1]
            ends[:-1] &= ~solid[1:]
            edge = offsets[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            begins[edge] = solid[edge]
            ends[edge - 1] = solid[edge - 1]
        self.raw = raw
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word, equal for equal words in any batch."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _BASE)]))
        span = np.diff(np.append(self.start, len(self.raw)))
        place = np.arange(int(self.start[0]), len(self.raw)) - np.repeat(self.start, span)
        np.minimum(place, len(powers) - 1, out=place)
        part = powers[place]
        part *= _BYTE_CODE_WORDS[self.raw[self.start[0] :]]
        total = np.add.reduceat(part, self.start - self.start[0])
        return mix64(total + size.astype(np.uint64) * _STEP)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one sequence of word hashes."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total *= _BASE
        total += words[j : j + n]
    return mix64(total + np.uint64(k * int(_STEP) % 2**64))


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the ascending distinct hashes of its k-word windows; a row of
    fewer words has one hash for the whole sequence, a row of none an empty set."""
    every = window_hashes(hashes, k) if len(hashes) >= k else np.zeros(0, np.uint64)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= k:
            own = np.sort(every[a : b - k + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif n:
            yield window_hashes(hashes[a:b], int(n))
        else:
            yield np.zeros(0, np.uint64)

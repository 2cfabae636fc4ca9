"""Texts of an Arrow batch as one byte buffer, and hashes of their words, without a loop over characters.

Everything here works inside a task on one batch at a time. Hashes depend on content only, so
every task and every rerun gives a word the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are handled in runs of about this size; a longer text is a run of its own
SHINGLE_BYTES = 1 << 18  # of texts whose shingles are made: every byte takes some 60 in arrays while its run is handled

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

# The white space of the contracts, and the letters that are lowered.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, row after the last, their bytes, and where each text starts in them.

    A null counts as an empty text.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset:column.offset + rows + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        stop = int(np.searchsorted(edges, edges[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop, data[edges[row]:edges[stop]], edges[row:stop + 1] - edges[row]
        row = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Powers:
    """Powers of the base and of its inverse, grown as longer buffers come."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, min(2 * len(cls.up), 2 * CHUNK_BYTES))
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            cls.up = np.multiply.accumulate(steps)
            steps = np.full(size, _BASE_INVERSE, np.uint64)
            steps[0] = 1
            cls.down = np.multiply.accumulate(steps)
        return cls.up[:n], cls.down[:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any range follows: one more entry than bytes."""
    up, _ = Powers.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    values = _BYTE_VALUES[data]
    values *= up
    np.cumsum(values, out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; equal ranges have equal hashes wherever they stand."""
    _, down = Powers.upto(len(sums))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def words(data: np.ndarray, edges: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of every word; a word never reaches over the end of its text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    starts = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    first = edges[:-1][edges[:-1] < edges[1:]]  # texts that have bytes
    starts[first] = inside[first + 1]
    last = edges[1:][edges[:-1] < edges[1:]] - 1
    stops[last] = inside[last + 1]
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each run of texts: its first row, the distinct shingle hashes text by text, in order, and where each text's start.

    Words are runs without white space after A-Z are lowered. A text of fewer words than the
    width has its whole sequence as its only shingle; one without words has none.
    """
    for row, _, data, edges in chunks(column, SHINGLE_BYTES):
        data = LOWER[data]
        start, stop = words(data, edges)
        word = range_hash(rolling(data), start, stop)
        first = np.searchsorted(start, edges)  # the first word of each text
        counts = np.diff(first)
        shingles = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        begin = np.concatenate([[0], np.cumsum(shingles)])
        total = int(begin[-1])
        # The word each shingle starts at: its text's first word, plus its place in the text.
        owner = np.repeat(np.arange(len(counts)), shingles)
        place = np.arange(total) - begin[:-1][owner]
        at = first[:-1][owner] + place
        value = np.zeros(total, np.uint64)
        padded = np.concatenate([word, np.zeros(width, np.uint64)])
        length = np.minimum(counts[owner], width)
        for i in range(width):
            value += np.where(i < length, padded[at + i], _U(0)) * _PLACES[i]
        value = mix(value + length.astype(np.uint64))
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            value[a:b].sort()
        fresh = np.ones(total, bool)
        fresh[1:] = value[1:] != value[:-1]
        fresh[begin[:-1][shingles > 0]] = True
        kept = np.concatenate([[0], np.cumsum(fresh)])
        yield row, value[fresh], kept[begin]

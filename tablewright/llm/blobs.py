"""Many small numeric rows as a few compressed blobs, one per bucket, for shuffles of whole buckets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import zstandard

_LEVEL = 1


def join(columns: Sequence[np.ndarray]) -> bytes:
    """Columns of any lengths, in one compressed blob."""
    columns = [np.ascontiguousarray(c) for c in columns]
    head = np.array([c.nbytes for c in columns], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=_LEVEL).compress(head + b"".join(c.tobytes() for c in columns))


def split(blob: bytes, kinds: Sequence[str]) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, "<u8", len(kinds))
    stops = 8 * len(kinds) + np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    return [np.frombuffer(data, k, (b - a) // np.dtype(k).itemsize, a) for k, a, b in zip(kinds, stops[:-1], stops[1:])]


def by_bucket(bucket: np.ndarray, columns: Sequence[np.ndarray], buckets: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket that has any, in their order."""
    order = np.argsort(bucket, kind="stable")
    spots = np.searchsorted(bucket[order], np.arange(buckets + 1))
    ranked = [c[order] for c in columns]
    for b in np.flatnonzero(spots[1:] > spots[:-1]).tolist():
        yield b, [c[spots[b]:spots[b + 1]] for c in ranked]


def gather(blobs: Sequence[bytes], kinds: Sequence[str]) -> list[np.ndarray]:
    """The rows of all blobs, one after the other."""
    parts = [split(b, kinds) for b in blobs]
    return [np.concatenate([np.zeros(0, k), *[p[i] for p in parts]]) for i, k in enumerate(kinds)]


def narrow(values: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of unsigned numbers."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].copy()


def wide(data: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = data.reshape(-1, size)
    return out.view("<u8").reshape(-1)

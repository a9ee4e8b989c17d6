"""Rolling hashes of windows and words over code points, for whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ..functions.batches import text_batches

#: Bytes of text that a task works on at once.
BLOCK_BYTES = 4_000_000
#: Code points over which powers are tabulated.
_TABLE = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        a = np.full(2 * _TABLE, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def window_hashes(points: np.ndarray, starts: np.ndarray, width: int | np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes (64 bits) of points[s : s + width] for ascending starts; equal windows have equal hashes anywhere. A
    width of its own for each start is allowed. Windows must be narrower than the table of powers."""
    if np.max(width, initial=0) >= _TABLE:
        raise ValueError(f"windows of {np.max(width)} characters are too wide")
    width = np.broadcast_to(np.asarray(width, np.int64), np.shape(starts))
    power, inverse = _powers()
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(points), _TABLE):
        i, j = np.searchsorted(starts, (lo, lo + _TABLE))
        if i == j:
            continue
        part = points[lo : int((starts[i:j] + width[i:j]).max())].astype(np.uint64) + np.uint64(salt + 1)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(29)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = (total[s + width[i:j]] - total[s]) * inverse[s]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(30)
    return out


def gathered(batches: Iterator[pa.RecordBatch], size_of: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about size_of bytes, whatever sizes come in."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in (x for whole in batches for x in text_batches(iter([whole]), "text", size_of)):
        held.append(b)
        size += b.nbytes
        if size >= size_of:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@lru_cache(maxsize=1)
def _in_word() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and where each text's words begin (one more
    entry than texts). Words are maximal runs of letters and digits in lower case."""
    points = [np.frombuffer(t.lower().encode("utf-32-le"), np.uint32) for t in texts]
    gap = np.array([32], np.uint32)
    all_ = np.concatenate([x for p in points for x in (p, gap)]) if points else np.zeros(0, np.uint32)
    inside = np.zeros(len(all_) + 2, np.int8)
    inside[1:-1] = _in_word()[all_]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    width = ends - starts
    long = width >= _TABLE
    h = window_hashes(all_, starts, np.where(long, 1, width))
    for i in np.flatnonzero(long):  # a word of a million letters and more
        h[i] = np.bitwise_xor.reduce(window_hashes(all_, np.arange(starts[i], ends[i]), 1) * (np.arange(width[i], dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
    borders = np.cumsum([0, *(len(p) + 1 for p in points)])
    return h, np.searchsorted(starts, borders)

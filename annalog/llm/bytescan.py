"""Whole-batch numpy scans of UTF-8 text: words, hashes and windows.

A block is the bytes of several whole documents in one ``uint8`` array with
their offsets. Every function works on a block at once, with no Python loop over
words or characters. A document longer than the block size is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18  # what a processor's second cache holds, at 8 bytes each

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse for i up to n, kept for the usual block size."""
    size = max(n + 1, 2 * BLOCK_BYTES + 1)
    if size in _POWERS:
        return _POWERS[size]
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if size == 2 * BLOCK_BYTES + 1:
        _POWERS[size] = (made[0], made[1])
    return made[0], made[1]


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes that part words: space and \\t \\n \\v \\f \\r."""
    return (data == 0x20) | (data - np.uint8(0x09) < 5)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return data + ((data - np.uint8(0x41) < 26).astype(np.uint8) << 5)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole rows, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside``, broken between documents."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each document's words begin among them."""
    starts, ends = spans(~is_space(data), offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words with one space before, between and after; where each word begins."""
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths
    out = np.full(int(lengths.sum()) + len(lengths) + 1, 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[at - 1] = False
    inside[-1] = False
    keep = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    out[inside] = lower(data[np.cumsum(keep[:-1]) > 0])
    return out, at


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of 64-bit values; equal ranges give equal hashes anywhere."""
    powers, inverses = _powers(len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes give equal hashes anywhere.

    Spans are in order and don't overlap. A long text is hashed a block of spans at a
    time, so that only a span longer than a block needs more than a block's memory.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 2 * BLOCK_BYTES, "right")))
        a, b = starts[lo], ends[hi - 1]
        out[lo:hi] = range_hash(_RANDOM[data[a:b]], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return out


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive values, by place of the first one."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + h[k : k + n]
    return mix(out)


def owners(counts_from: np.ndarray) -> np.ndarray:
    """Document index of each item, from where each document's items begin."""
    return np.repeat(np.arange(len(counts_from) - 1), np.diff(counts_from))


def per_document(values: np.ndarray, counts_from: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's items."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[counts_from[1:]] - total[counts_from[:-1]]

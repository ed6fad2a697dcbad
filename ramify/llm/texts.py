"""Whole columns of text as flat numpy arrays, in pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text worked on at once, in bytes; one longer document is a piece of its own.
PIECE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER_1 = _LOWER.astype(np.uint64) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def give_back() -> None:
    """Return memory that this process has freed to the system: workers wait for later tasks with all they ever held."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over a task's batches, which gives freed memory back when the task ends."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, after last, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, offsets = flat(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def _first_powers(base: int) -> np.ndarray:
    return powers(base, PIECE_BYTES)


def _kept_powers(base: int, n: int) -> np.ndarray:
    """``powers``, kept for runs of usual length."""
    return _first_powers(base)[:n] if n <= PIECE_BYTES else powers(base, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``, or run of bytes not in ``space``; rows never share a word."""
    inside = ~space[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts[offsets[filled]] = inside[offsets[filled]]
    ends[offsets[filled + 1] - 1] = inside[offsets[filled + 1] - 1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of every word, A-Z as a-z."""
    start, end, row = words(data, offsets)
    return run_hashes(data, start, end), row


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes, A-Z as a-z: differences of running polynomial sums."""
    summed = np.zeros(len(data) + 1, np.uint64)
    np.take(_LOWER_1, data, out=summed[1:], mode="clip")
    summed[1:] *= _kept_powers(_BASE, len(data))
    np.cumsum(summed[1:], out=summed[1:])
    raw = (summed[end] - summed[start]) * _kept_powers(_INVERSE, len(data))[start] if len(start) else summed[:0]
    return mixed(raw ^ (end - start).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows begins in a sorted list of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] numbers), first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def runs(column: pa.Array, space: np.ndarray, limit: int = PIECE_BYTES, beyond: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int | None]]:
    """``pieces``, with a text of more than ``2 limit`` bytes cut between words (runs of bytes not in ``space``).

    A cut text has ``beyond`` words of the next part at the end of each; the last value is the number of words
    before them, None where nothing was cut.
    """
    for first, last, data, offsets in pieces(column, limit):
        if len(data) <= 2 * limit:
            yield first, last, data, offsets, None
            continue
        # longer than the limit, so of one row
        start, end, _ = words(data, offsets, space)
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + limit)))
            part = data[start[lo] : end[min(len(start), hi + beyond) - 1]]
            yield first, last, part, np.array([0, len(part)]), min(hi, len(start)) - lo
            lo = hi

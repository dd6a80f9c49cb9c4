"""Vectorised words and word hashes of whole texts.

All functions work on the byte buffer of an Arrow string column, for many texts at once. A word
is a maximal run of bytes outside 0x20 and 0x09-0x0D after lower-casing A-Z; since these bytes
never occur inside a multi-byte UTF-8 character, byte words equal character words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes that are neither letters nor digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
#: Bytes of text handled at a time (a longer text is handled alone); bounds a worker's memory.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_STEP))[_LOWER]
_POWERS = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """Powers 0..n-1 of the odd base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1024), _STEP, U)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, bounds


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``limit`` bytes."""
    data, bounds = byte_column(column)
    n, at = len(bounds) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, end, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def word_spans(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row): word i covers bytes starts[i]:ends[i]."""
    inside = ~separators[data]
    first = np.empty(len(data), bool)
    last = np.empty(len(data), bool)
    if len(data):
        first[0] = last[-1] = True
        np.logical_not(inside[:-1], out=first[1:])
        np.logical_not(inside[1:], out=last[:-1])
        first[bounds[:-1][bounds[:-1] < len(data)]] = True
        last[bounds[1:][bounds[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    origin = np.zeros(len(data), np.int32 if len(data) < 1 << 31 else np.int64)
    origin[starts[1:]] = np.diff(starts)
    origin[: starts[0]] = 0
    place = np.arange(len(data), dtype=np.int64) - np.cumsum(origin, dtype=np.int64) - starts[0]
    np.clip(place, 0, int(lengths.max()), out=place)
    total = np.cumsum(_BYTE[data] * powers(int(lengths.max()) + 1)[place], dtype=U)
    out = total[ends - 1]
    out -= np.where(starts > 0, total[starts - 1], U(0))
    return mix(out + lengths.astype(U))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size``-word windows of one text; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, size)
    out = np.zeros(n - width + 1, U)
    for k in range(width):
        out *= U(0xC2B2AE3D27D4EB4F)
        out += words[k : n - width + 1 + k]
    return mix(out + U(width))

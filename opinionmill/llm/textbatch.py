"""Vectorised text work on Arrow batches.

A batch's string column is handled as one buffer of UTF-8 bytes plus offsets.
Slices of whole rows keep temporaries to a few dozen megabytes; a single text
longer than a slice is still processed whole, in windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 19

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, min(2 * len(_powers), SLICE_BYTES + 1), 1 << 16)
        factors = np.full(size, np.uint64(_BASE))
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=np.uint64)
        factors = np.full(size, np.uint64(_INVERSE))
        factors[0] = 1
        _inverses = np.cumprod(factors, dtype=np.uint64)
    return _powers, _inverses


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary()).fill_null(b"") if binary else column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, ends


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows."""
    raw, ends = buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop
    # Worker processes live on after a task; what Arrow has freed is given back.
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """White-space words of each row: row index, first byte and end byte."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    gap = SPACE[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = gap[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = True
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = gap[1:]
    lasts = offsets[1:]
    after[lasts[lasts > 0] - 1] = True
    ink = ~gap
    starts, stops = np.flatnonzero(ink & before), np.flatnonzero(ink & after) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, stops


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: an odd-base polynomial, then mixed with its length."""
    powers, inverses = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * inverses[starts] + (stops - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row index and hash of every word; long buffers are cut between words."""
    rows, starts, stops = words(data, offsets)
    return rows, long_span_hashes(LOWER[data] if lower else data, starts, stops)


def long_span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Span hashes, of a long buffer piece by piece; pieces end between spans."""
    if len(data) <= SLICE_BYTES:
        return span_hashes(data, starts, stops) if len(starts) else np.zeros(0, dtype=np.uint64)
    parts, at = [], 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + SLICE_BYTES)))
        base = starts[at]
        parts.append(span_hashes(data[base : stops[end - 1]], starts[at:end] - base, stops[at:end] - base))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def shingle_hashes(rows: np.ndarray, hashes: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of `width` words with their row, rows ascending; a row with fewer words is one shingle."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    counts = np.bincount(rows, minlength=n_rows)
    full = len(hashes) - width + 1
    parts_rows, parts = [], []
    if full > 0:
        value = hashes[:full].copy()
        for k in range(1, width):
            value = mix(value * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + full])
        ok = rows[:full] == rows[width - 1 :]
        parts_rows.append(rows[:full][ok])
        parts.append(value[ok])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(rows, short)
        value = hashes[first].copy()
        for k in range(1, width - 1):
            more = counts[short] > k
            value[more] = mix(value[more] * np.uint64(0xD6E8FEB86659FD93) + hashes[first[more] + k])
        parts_rows.append(short)
        parts.append(mix(value ^ (counts[short].astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))))
    at, value = np.concatenate(parts_rows), np.concatenate(parts)
    order = np.argsort(at, kind="stable")
    return at[order], value[order]

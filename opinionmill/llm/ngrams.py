"""Hashed n-grams of UTF-8 bytes and of words, for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .textbatch import LOWER, SPACE, long_span_hashes, mix

#: A single text beyond this many bytes is worked on in windows.
WINDOW_BYTES = 1 << 22
_FOLD = LOWER.copy()
_FOLD[SPACE] = 0x20


def byte_ngrams(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte, ASCII letters lower-cased, white space as one kind."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(order):
        h = (h ^ data[k : k + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return h * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)


def fold(data: np.ndarray) -> np.ndarray:
    return _FOLD[data].astype(np.uint32)


def windows(data: np.ndarray, offsets: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The slice itself, or a single long text in windows that share `overlap` bytes."""
    if len(data) <= WINDOW_BYTES or len(offsets) != 2:
        yield data, offsets
        return
    for at in range(0, len(data) - overlap, WINDOW_BYTES):
        part = data[at : at + WINDOW_BYTES + overlap]
        yield part, np.array([0, len(part)])


def folded_windows(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Order, folded bytes and offsets; the windows of an order overlap so that each of its n-grams lies in exactly one."""
    whole = fold(data) if len(data) <= WINDOW_BYTES or len(offsets) != 2 else None
    for order in orders:
        if whole is not None:
            yield order, whole, offsets
        else:
            for part, at in windows(data, offsets, order - 1):
                yield order, fold(part), at


def row_sums(values: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Sum, for each row, of the values at starts of n-grams that lie within the row."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    last = len(values)
    ends = np.clip(offsets[1:] - order + 1, offsets[:-1], last)
    return sums[ends] - sums[np.minimum(offsets[:-1], last)]


#: Byte classes of a token: 0 white space, 1 letters, digits and bytes beyond ASCII, 2 the rest.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[SPACE] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:256] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row index and hash of each token: a run of bytes of one class, white space left out."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    kind = _KIND[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    edge[1:] = kind[1:] != kind[:-1]
    firsts = offsets[:-1]
    edge[firsts[firsts < len(data)]] = True
    starts = np.flatnonzero(edge)
    stops = np.append(starts[1:], len(data))
    keep = kind[starts] > 0
    starts, stops = starts[keep], stops[keep]
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.searchsorted(offsets, starts, side="right") - 1, long_span_hashes(data, starts, stops)


#: Stand-ins for the second word of a pair that repeats its first, next to it or one further on.
_AGAIN = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], dtype=np.uint64)


def word_ngrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row index and bucket of every token, of every pair of neighbours, and of every pair that repeats a word.

    Repeating pairs share a bucket for each distance, whatever the word.
    """
    rows, hashes = tokens(data, offsets)
    if not len(rows):
        return rows, np.zeros(0, dtype=np.int64)
    same = rows[1:] == rows[:-1]
    at = [rows, rows[:-1][same]]
    found = [hashes, mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:])[same]]
    for gap in (1, 2):
        again = (hashes[gap:] == hashes[:-gap]) & (rows[gap:] == rows[:-gap])
        at.append(rows[gap:][again])
        found.append(np.full(len(at[-1]), mix(_AGAIN[gap - 1 : gap])[0]))
    return np.concatenate(at), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)

"""Numpy kernels over the bytes of a column of texts, used inside tasks.

A column arrives as one byte array and row offsets, straight from Arrow: no Python string is made per word. Work goes
on in runs of rows of about ``CHUNK`` bytes, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
_M = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_MIX_STEP = np.uint64(0xD6E8FEB86659FD93)

#: Space, tab, line feed, vertical tab, form feed, carriage return: the bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M[0]
    x = (x ^ (x >> np.uint64(27))) * _M[1]
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1 + (n >> 2), 1 << 16)
        both = []
        for base in (_STEP, _BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if size > 4 * CHUNK:  # of one very long text: not kept
            return both[0], both[1]
        _powers = both[0], both[1]
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, rows)
        lo = min(hi, rows)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of rows.

    ``start`` and ``end`` are byte positions in ``data``; the words of row ``i`` are ``first[i]:first[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        solid = ~SPACE[data]
        begins, ends = solid.copy(), solid.copy()
        if len(data):
            begins[1:] &= ~solid[:-1]
            ends[:-1] &= ~solid[1:]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            begins[inner] |= solid[inner]
            ends[inner - 1] |= solid[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit value per word; with ``lower``, A-Z count as a-z."""
        up, back = _power(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTES)[self.data] * up[:len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * back[self.start]
                   + (self.end - self.start).astype(np.uint64))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit value per window of ``k`` values; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _MIX_STEP
        out += words[j:j + n]
    return mix(out + np.uint64(k))


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct windows of ``k`` words; of fewer words, the whole sequence as one."""
    h = words.hashes()
    every = windows(h, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(every[a:b - k + 1])
        else:
            yield windows(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def text_runs(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """The column's words by runs of rows."""
    data, offsets = text_bytes(column)
    for lo, hi in runs(offsets, limit):
        own = offsets[lo:hi + 1]
        yield lo, hi, Words(data[own[0]:own[-1]], own - own[0])

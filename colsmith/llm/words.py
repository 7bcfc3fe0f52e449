"""Vectorised words and shingles over Arrow batches of texts.

A word is a run of bytes other than space and \\x09-\\x0D, which is the same whether bytes or
code points are looked at. Words and shingles are 64-bit hashes of their bytes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes of text handled at a time

_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def lean(run):
    """A function of batches whose worker holds no freed memory: Arrow allocates from the system, and the rest goes back when the partition ends."""

    @functools.wraps(run)
    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (a finaliser of xor-shifts and products)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1024), _PRIME, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a column in stretches of about ``size`` bytes: first row, end row, bytes, offsets."""
    data, offsets = text_buffer(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, length and row of each word, in order."""
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] |= inside[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, starts
    begins = (np.cumsum(inside)[starts] - 1).astype(np.int64)
    packed = data[inside]
    lengths = np.diff(np.append(begins, len(packed)))
    place = np.arange(len(packed)) - np.repeat(begins, lengths)
    values = (packed.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(values, begins)), starts, lengths, np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of k words of a row; a row with fewer words is one window."""
    n = len(hashes)
    if not n:
        return hashes, rows
    out, factors = np.zeros(n, np.uint64), _powers(k)
    for j in range(min(k, n)):
        same = rows[j:] == rows[: n - j]
        out[: n - j] += np.where(same, hashes[j:] * factors[j], np.uint64(0))
    full = np.zeros(n, bool)
    if n >= k:
        full[: n - k + 1] = rows[k - 1 :] == rows[: n - k + 1]
    full[np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))] = True
    index = np.flatnonzero(full)
    return mix(out[index]), index


def row_order(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The order by row that brings equal values of a row together."""
    if len(rows) and rows[-1] < 1 << 16:  # rows come in order: sort on the row and the upper bits of the value
        key = (rows.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16))
        order = np.argsort(key)
        key, found = key[order], values[order]
        if not ((key[1:] == key[:-1]) & (found[1:] != found[:-1])).any():
            return order  # no two values share the upper bits
    return np.lexsort((values, rows))


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, in order of the rows."""
    order = row_order(values, rows)
    values, rows = values[order], rows[order]
    keep = np.append(True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])) if len(values) else np.zeros(0, bool)
    return values[keep], rows[keep]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[offsets])

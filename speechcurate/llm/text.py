"""Words, lines and hashes of Arrow text batches, as NumPy arrays over the UTF-8 bytes.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. Hashes have 64 bits and are
taken as the word, line or shingle itself: among a billion distinct values two fall together with
a chance of about 3 %. Nulls are empty texts.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes of text worked on at once; bounds the temporary arrays
SEED = 0x9E3779B97F4A7C15
_BASE = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def series(n: int, seed: int = 0) -> np.ndarray:
    """``n`` pseudorandom 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(SEED))


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE = series(256, 1) | np.uint64(1)
_VALUE[WHITE] = 0
_LOWER = _VALUE.copy()
_LOWER[0x41:0x5B] = _VALUE[0x61:0x7B]
_LINE = series(256, 2) | np.uint64(1)
_LINE[0x0A] = 0
_ORDER = series(16, 3) | np.uint64(1)
_powers = np.ones(1, np.uint64)
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE)], dtype=np.uint64)
    return _powers


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes; a longer row is a run of its own."""
    data, off = buffers(column)
    at, rows = 0, len(off) - 1
    while at < rows:
        to = int(np.searchsorted(off, off[at] + (limit or CHUNK), "right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to
    # Idle workers keep what their allocators keep.
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


class Words:
    """Words of a run of texts: byte ``start`` and ``end``, ``hash``, and ``rows``, the n + 1 word offsets of the texts.

    ``apart`` marks the bytes between words; ``values`` gives each byte its value in the hash, 0 for those between words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, apart: np.ndarray = WHITE, values: np.ndarray | None = None):
        word = ~apart[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = off[(off > 0) & (off < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.start, off)
        self.hash = segment_hash(data, self.start, values if values is not None else _LOWER if lower else _VALUE)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def segment_hash(data: np.ndarray, start: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of each segment that begins at ``start`` and ends before the next; bytes of value 0 don't count at its end."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):  # pieces of bounded length, so that a huge text needs no huge temporary arrays
        to = min(max(int(np.searchsorted(start, start[at] + 2 * CHUNK, "right")) - 1, at + 1), len(start))
        stop = start[to] if to < len(start) else len(data)
        piece, begin = data[start[at] : stop], start[at:to] - start[at]
        size = np.diff(np.r_[begin, len(piece)])
        inside = np.arange(len(piece)) - np.repeat(begin, size)
        out[at:to] = np.add.reduceat(values[piece] * _power(int(size.max()))[inside], begin)
        at = to
    return mix(out)


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within each text, and the n + 1 offsets of the texts among them."""
    count = np.maximum(np.diff(rows) - n + 1, 0)
    off = np.r_[0, np.cumsum(count)]
    at = np.arange(off[-1]) + np.repeat(rows[:-1] - off[:-1], count)
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += hashes[at + k] * _ORDER[k]
    return mix(total), off


def lines(data: np.ndarray, off: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``\\n``-split line that has a word."""
    begin = np.unique(np.r_[off[:-1][np.diff(off) > 0], np.flatnonzero(data == 0x0A) + 1])
    begin = begin[begin < len(data)]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = segment_hash(data, begin, _LINE)
    stop = np.r_[begin[1:], len(data)]
    full = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    row = np.searchsorted(off, begin, "right") - 1
    return row[full], hashes[full]


def unique_pairs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ordered, with their counts."""
    if not len(row):
        return row, value, np.zeros(0, np.int64)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.r_[at, len(row)])

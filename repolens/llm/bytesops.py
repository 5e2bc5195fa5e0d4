"""Vectorised byte, word and shingle primitives over Arrow string batches.

Every Python stage of the subpackage works on Arrow batches of whole texts. A batch is cut into slices of a
few megabytes (a single longer text is a slice of its own), each slice is one ``uint8`` buffer, and words,
hashes and windows are computed with numpy over the buffer, so no Python code runs per byte or per word.

Word hashes are position-tabulated: each (position, byte) cell has its own random 64-bit value and a word is
the sum of its cells, finished with an avalanche mix. Two different words collide with probability 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..functions.workers import importable

SLICE_BYTES = 1 << 20
ARROW_ROWS = 512
ARROW_BYTES = 4 << 20

_POSITIONS = 64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser on uint64 values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keyed(n: int, seed: int) -> np.ndarray:
    """n pseudo-random uint64 values that depend on the seed only."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(base + mix64(np.array([seed], dtype=np.uint64))[0])


_CELLS = keyed(_POSITIONS * 256, 11)

#: ASCII whitespace splits words; everything else, other alphabets included, belongs to one.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
WORD_BY_SPACE = ~SPACES

#: Letters and digits of ASCII and every non-ASCII byte belong to a word.
WORD_BY_ALNUM = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BY_ALNUM[_low:_high] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Slice:
    """Consecutive texts of a batch. first: index of the first text in the batch; off: n + 1 byte offsets."""

    first: int
    data: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1


def trim() -> None:
    """Give freed memory back to the system, so that idle workers do not keep their peak."""
    if _TRIM is not None:
        _TRIM(0)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    else:
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column in slices of at most ``most`` bytes, or of one text."""
    raw, off = _buffer(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        to = min(to, n)
        yield Slice(at, raw[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to
    trim()


@dataclass
class Words:
    """Words of a slice: byte range of each, and first word of each text (n + 1 entries)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def spans(piece: Slice, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes inside a text, and the first run of each text."""
    inside = member[piece.data]
    size = len(inside)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(piece.n + 1, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = piece.off[1:-1]
    left = edge[(edge > 0) & (edge < size)]
    begins[left] |= inside[left]
    ends[left - 1] |= inside[left - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, piece.off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges are disjoint and ascending."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    total = int(length.sum())
    base = np.zeros(len(start), np.int64)
    np.cumsum(length[:-1], out=base[1:])
    place = np.arange(total, dtype=np.int64)
    within = place - np.repeat(base, length)
    cell = _CELLS[((within & (_POSITIONS - 1)) << 8) | data[within + np.repeat(start, length)]]
    if len(far := np.flatnonzero(within >= _POSITIONS)):
        cell[far] *= mix64((within[far] >> 6).astype(np.uint64)) | np.uint64(1)
    return mix64(np.add.reduceat(cell, base) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(piece: Slice, member: np.ndarray, lower: bool = True) -> Words:
    """The words of a slice, hashed after ASCII lower-casing (or as they are)."""
    start, end, first = spans(piece, member)
    return Words(start, end, first, span_hashes(LOWER[piece.data] if lower else piece.data, start, end))


def grams(hashes: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Hash of every k consecutive entries; text borders are the caller's concern."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for j, c in enumerate(keyed(k, seed) | np.uint64(1)):
        out += mix64(hashes[j : len(hashes) - k + 1 + j] + c)
    return mix64(out + np.uint64(k))


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits, for Spark's bigint."""
    return x.view(np.int64)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of the next entry, and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, count)


def bounded_batches(spark) -> None:
    """Arrow batches small enough that a worker's memory does not depend on how long the texts are.

    Also lets the workers import this package in sessions started elsewhere.
    """
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)

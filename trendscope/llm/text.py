"""Vectorised words, shingles and windows of a batch of texts, inside Spark tasks.

A batch is cut into slices of about ``SLICE_BYTES`` of text (one long text is one slice), so
that memory follows the slice, not the Arrow batch. Words are runs of bytes other than
x20 and x09-x0D. Every word has a 64-bit polynomial hash over randomised byte values; hashes
of shingles and windows are built from word hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then the free memory that this worker's allocators hold goes back to the
    system, as the worker stays for other tasks."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        seq = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        seq[0] = 1
        have = np.multiply.accumulate(seq)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Texts:
    """Bytes of some texts: ``buf`` and the offsets ``off`` of the n texts (null: empty)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1

    @staticmethod
    def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
        """(index of the first row, its texts) for slices of a string column."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = int(np.searchsorted(off, off[at] + size, side="right")) - 1
            to = min(max(to, at + 1), len(column))
            yield at, Texts(buf[off[at]:off[to]], off[at:to + 1] - off[at])
            at = to


class Words:
    """Words of ``Texts``: byte positions ``start``/``end``, text index ``row``, and
    ``first[i]:first[i + 1]``, the words of text i."""

    def __init__(self, texts: Texts):
        solid = ~SPACE[texts.buf]
        edge = np.zeros(len(solid) + 1, dtype=bool)
        edge[texts.off] = True
        before, after = np.empty_like(solid), np.empty_like(solid)
        if len(solid):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.texts = texts
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, texts.off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(texts.n), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        buf = _LOWER[self.texts.buf] if lower else self.texts.buf
        power = powers(_BASE, len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf] * power[:-1], out=sums[1:])
        back = powers(pow(_BASE, -1, 1 << 64), len(buf) + 1)
        h = (sums[self.end] - sums[self.start]) * back[self.start]
        return mix(h + U(0x2545F4914F6CDD1D) * (self.end - self.start).astype(np.uint64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes, by its first word (len - n + 1 of them)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    power = powers(_STEP, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[:-1], out=sums[1:])
    back = powers(pow(_STEP, -1, 1 << 64), len(words) + 1)
    return mix((sums[n:] - sums[:-n]) * back[:len(words) - n + 1] + U(n))


def shingles(w: Words, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every n-word shingle; a text with fewer words (but one) has its
    whole sequence as one shingle. Repeats stay."""
    h = window_hashes(hashed, n)
    inside = np.arange(len(h)) + n <= w.first[1:][w.row[:len(h)]] if len(h) else np.zeros(0, bool)
    rows, out = w.row[:len(h)][inside], h[inside]
    few = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(few):
        extra = np.array([window_hashes(hashed[w.first[i]:w.first[i + 1]], int(w.count[i]))[0] for i in few],
                         dtype=np.uint64)
        rows, out = np.concatenate([rows, few]), np.concatenate([out, extra])
    return rows, out


def shingle_sets(w: Words, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, sorted by text and hash, without repeats."""
    rows, h = shingles(w, hashed, n)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], h[new]


def lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """A list column of n rows from values sorted by row."""
    off = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))

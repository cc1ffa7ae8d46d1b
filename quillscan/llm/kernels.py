"""Vectorised text kernels over Arrow string buffers: no Python object per word."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that a kernel takes at once; temporaries are some 60 times as large.
CHUNK_BYTES = 1 << 20

IS_WORD = np.zeros(256, bool)
IS_WORD[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((x >> U(11)).astype(np.float64) + 1.0) / 9007199254740992.0


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind, column = np.int32, column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes each; a longer row stands alone, whole."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words ``[0-9A-Za-z\\x80-]+``, and each row's first word; no word crosses rows."""
    inside = IS_WORD[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lower-cased, and each row's first word (with the end as last)."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, U), first
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    letters = LOWER[data[np.repeat(starts, lengths) + inside]].astype(U) + U(1)
    h = np.add.reduceat(letters * powers(int(lengths.max()))[inside], at)
    return mix(h + lengths.astype(U) * U(0xD6E8FEB86659FD93)), first


def shingle_cells(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shingles of ``size`` words as unit cells: the n-th copy of a shingle is a cell of its own, so the
    weighted Jaccard similarity of two rows is the plain Jaccard similarity of their cells.

    A row of fewer words has one shingle, of all its words. Returns the cells (int64) and their rows.
    """
    h, first = word_hashes(data, offsets)
    n = len(h)
    count = np.diff(first)
    made = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    rows = np.repeat(np.arange(len(count)), made)
    if not len(rows):
        return np.zeros(0, np.int64), rows
    at = np.concatenate(([0], np.cumsum(made)[:-1]))
    begin = np.repeat(first[:-1], made) + (np.arange(len(rows)) - np.repeat(at, made))
    last = np.repeat(first[1:], made)
    s = np.zeros(len(rows), U)
    factors = powers(size + 1, U(0xC2B2AE3D27D4EB4F))
    for k in range(size):
        there = begin + k
        s += np.where(there < last, h[np.minimum(there, n - 1)], U(0)) * factors[k + 1]
    s = mix(s)
    key = mix(s + rows.astype(U) * U(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    starts = np.flatnonzero(new)
    occurrence = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    which = np.empty(len(order), np.int64)
    which[order] = occurrence
    return mix(s + which.astype(U) * U(0x9FB21C651E98DF25)).view(np.int64), rows


def release() -> None:
    """Hands memory that this process has freed back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with ``release`` after it: Spark keeps workers for later stages, where what they hoard counts as their executor's."""

    @functools.wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return released


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of the given row lengths."""
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal first column, from rows that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        if held and len(key) and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = 0
        for cut in np.flatnonzero(key[1:] != key[:-1]) + 1:
            held.append(batch.slice(last, cut - last))
            yield pa.Table.from_batches(held)
            held, last = [], cut
        if last < batch.num_rows:
            held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)

"""Vectorised word and shingle hashing over Arrow string columns.

A batch is handled as one byte buffer: words are maximal runs of letters, digits
and non-ASCII bytes of the lower-cased text; a word's 64-bit hash comes from
prefix sums of a polynomial with wrap-around, so no Python object is made a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _c in range(128):
    WORD_BYTE[_c] = chr(_c).isalnum()

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        a = np.full(size, _BASE, U64)
        b = np.full(size, _INVERSE, U64)
        a[0] = b[0] = 1
        _powers, _inverses = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    """mix() of one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls have no bytes."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about `limit` bytes of text each (a longer text is a slice of its own)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
        for lo in range(int(a), int(b), 60_000):
            yield batch.slice(lo, min(60_000, int(b) - lo))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back: it lives on and would keep its largest need."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


class Words:
    """Words of a string column: start, end (bytes), doc (row) and hash of each."""

    __slots__ = ("raw", "ends", "start", "end", "doc", "hash", "count", "rows", "sums")

    def __init__(self, column: pa.Array, lower: bool = True):
        if lower:
            column = pc.utf8_lower(column)
        raw, ends = string_buffers(column)
        self.raw, self.ends, self.rows = raw, ends, len(column)
        inside = WORD_BYTE[raw]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        first = ends[:-1][ends[:-1] < ends[1:]]
        starts[first] = inside[first]  # a word never runs over a document's edge
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        last = ends[1:][ends[:-1] < ends[1:]] - 1
        stops[last] = inside[last]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        power, _ = _tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, U64)
        sums = self.sums[1:]
        sums += raw
        sums += U64(1)
        sums *= power[: len(raw)]
        np.cumsum(sums, out=sums)
        self.hash = mix(self.span(self.start, self.end))
        cut = np.searchsorted(self.start, ends)
        self.count = np.diff(cut)
        self.doc = np.repeat(np.arange(self.rows), self.count)


    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial hash of the bytes of each span, wherever it lies."""
        h = self.sums[end]
        h -= self.sums[start]
        h *= _inverses[start]
        return h

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of the first `length` bytes of each word longer than that."""
        long = np.flatnonzero(self.end - self.start > length)
        start = self.start[long]
        return self.doc[long], mix(self.span(start, start + length) + U64(mix_int(length)))


_STEP = [U64(mix_int(k + 101) | 1) for k in range(64)]


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each run of `size` words; a shorter non-empty text is one shingle."""
    h, doc, n = words.hash, words.doc, len(words.hash)
    if not n:
        return doc, h
    total = np.zeros(n, U64)
    for k in range(min(size, n)):
        part = h[k:] * _STEP[k]
        same = doc[k:] == doc[: n - k]
        total[: n - k] += np.where(same, part, U64(0))
    ends = np.zeros(n, bool)
    if n >= size:
        ends[: n - size + 1] = doc[size - 1 :] == doc[: n - size + 1]
    first = np.cumsum(words.count) - words.count
    short = (words.count > 0) & (words.count < size)
    ends[first[short]] = True
    return doc[ends], mix(total[ends])


def multisets(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, 48-bit hash, count) of distinct values a document, sorted; fewer than 65536 documents."""
    key = (doc.astype(U64) << U64(48)) | (value >> U64(16))
    key.sort()
    if not len(key):
        return doc, key, np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[new, len(key)])
    key = key[new]
    return (key >> U64(48)).astype(np.int64), key & U64((1 << 48) - 1), count


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def binary_array(raw: np.ndarray, byte_counts: np.ndarray) -> pa.Array:
    """A binary column from the bytes of all rows and the length of each."""
    offsets = np.zeros(len(byte_counts) + 1, np.int32)
    np.cumsum(byte_counts, out=offsets[1:])
    raw = np.ascontiguousarray(raw).view(np.uint8)
    return pa.BinaryArray.from_buffers(pa.binary(), len(byte_counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])

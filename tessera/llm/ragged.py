"""Batches of texts as one byte array with offsets, and numpy passes over all of them at once.

Every function works on a slice of an Arrow column: `data` holds the UTF-8 bytes of all
its texts, `offsets` the n + 1 borders. Slices are cut so that a worker's memory is
bounded by SLICE_BYTES and the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.RandomState(20240607)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.randint(0, 2**63, 1 << 14, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tidy(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives free memory back after each batch and at its end: workers
    are kept for later tasks, and what they hold meanwhile is taken from their executor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def inputs() -> Iterator[pa.RecordBatch]:
            for b in it:
                yield b
                del b
                pa.default_memory_pool().release_unused()

        yield from batches(inputs())
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library keeps freed memory
            trim(0)

    return run


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of an Arrow string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, raw = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def row_starts(offsets: np.ndarray) -> np.ndarray:
    """Where texts that are not empty begin."""
    return offsets[:-1][offsets[1:] > offsets[:-1]]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none of which crosses a text's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = row_starts(offsets)
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each span begins."""
    return np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def concat_spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indices of all elements of all spans, in order."""
    n = ends - starts
    total = int(n.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    at = np.cumsum(n) - n
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, n)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are in order, do not overlap and are not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    if int(n.sum()) == len(data):
        raw, at = data, starts
    else:
        at = np.cumsum(n) - n
        raw = data[concat_spans(starts, ends)]
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(at, n)
    terms = _BYTE[raw] * _PLACE[place & (len(_PLACE) - 1)]
    if int(n.max()) > len(_PLACE):  # a factor of its own for each further stretch of a long span
        far = np.flatnonzero(place >= len(_PLACE))
        terms[far] *= mix((place[far] // len(_PLACE)).astype(np.uint64)) | np.uint64(1)
    h = np.add.reduceat(terms, at)
    return mix(h + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each, distinct values, first index of each distinct value)."""
    codes, values = pd.factorize(h)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
    return codes, values, first


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def byte_classes(data: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The class, by the table `of` over code points, of the character to which each byte belongs."""
    out = of[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b0 = data[lead]
        for size, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
            at = lead[(b0 >= low) & (b0 < high)]
            if len(at):
                code = data[at].astype(np.uint32) & np.uint32(bits)
                for k in range(1, size):
                    code = (code << np.uint32(6)) | (data[at + k].astype(np.uint32) & np.uint32(0x3F))
                kind = of[code]
                for k in range(size):
                    out[at + k] = kind
    return out


class Cache:
    """Rows of numbers by uint64 key, in sorted arrays: found and added for whole arrays of keys.
    Beyond `limit` rows it starts anew, so that its memory is bounded."""

    def __init__(self, limit: int, width: int, kind: type):
        self.limit, self.empty = limit, (np.zeros(0, np.uint64), np.zeros((0, width), kind))
        self.keys, self.rows = self.empty

    def get(self, keys: np.ndarray, make) -> np.ndarray:
        """The rows of distinct keys; make(places) gives the rows of those at places that are new."""
        out = np.empty((len(keys), self.rows.shape[1]), self.rows.dtype)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        out[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = make(new)
            if len(self.keys) + len(new) > self.limit:
                self.keys, self.rows = self.empty
            every = np.concatenate([self.keys, keys[new]])
            order = np.argsort(every, kind="stable")
            self.keys, self.rows = every[order], np.concatenate([self.rows, out[new]])[order]
        return out


class HashIndex:
    """A read-only map from uint64 keys to their positions, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.key, self.at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, k = np.arange(len(keys), dtype=np.int32), np.asarray(keys, np.uint64)
        slot, self.probes = self._slot(k), 0
        while len(left):
            self.probes += 1
            free = self.at[slot] < 0
            take, where = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[where]
            self.at[take], self.key[take] = left[won], k[left[won]]
            keep = np.ones(len(left), bool)
            keep[won] = False
            left, slot = left[keep], (slot[keep] + 1) & (size - 1)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Positions, -1 where a key is absent."""
        slot = self._slot(k)
        at = self.at[slot]
        out = np.where(self.key[slot] == k, at, np.int32(-1))
        open_ = np.flatnonzero((at >= 0) & (out < 0))
        while len(open_):
            s = (slot[open_] + 1) & (len(self.at) - 1)
            slot[open_] = s
            at = self.at[s]
            hit = (at >= 0) & (self.key[s] == k[open_])
            out[open_[hit]] = at[hit]
            open_ = open_[(at >= 0) & ~hit]
        return out

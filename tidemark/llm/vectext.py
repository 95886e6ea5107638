"""Vectorised words, shingles and their 64-bit hashes over Arrow batches of texts.

Everything works on the UTF-8 bytes of a whole batch at once: words are runs of
bytes other than space and \\x09-\\x0D, A-Z are lower-cased on request, and a word's
hash is a difference of prefix sums, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes hashed at once; small enough for the arrays to stay in a core's cache.
SEGMENT = 1 << 18

_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_M, SEGMENT + (1 << 16))
_INV = _powers(_M_INV, SEGMENT + (1 << 16))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21, each: int = 0) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about `most` bytes, one row at least; each: bytes that a row has besides its text."""
    _, offs = utf8(batch.column(batch.schema.get_field_index(column)))
    offs = offs + each * np.arange(len(offs))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans are in order and don't overlap."""
    code = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        last = int(ends[j - 1])
        n = last - base
        power, inverse = (_POW, _INV) if n <= len(_POW) else (_powers(_M, n), _powers(_M_INV, n))
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(code[data[base:last]] * power[:n], out=sums[1:])
        s = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in order, and the words per row."""
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    space = SPACE[data]
    edge = np.zeros(size + 1, bool)
    edge[offs] = True  # a row's first byte begins a word
    before = np.empty(size, bool)
    before[0] = True
    np.logical_or(space[:-1], edge[1:-1], out=before[1:])
    starts = np.flatnonzero(~space & before)
    after = np.empty(size, bool)
    after[-1] = True
    np.logical_or(space[1:], edge[1:-1], out=after[:-1])
    ends = np.flatnonzero(~space & after) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return hashes(data, starts, ends, lower), starts, ends, counts


def shingles(h: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row in order, and their number per row.

    A row with fewer words has one shingle, its whole sequence; without words, none.
    """
    n_out = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    out = np.empty(int(n_out.sum()), np.uint64)
    begin = np.cumsum(n_out) - n_out
    full = counts >= k
    if full.any():
        s = h[: len(h) - k + 1] * _PLACE[0]
        for j in range(1, k):
            s += h[j : len(h) - k + 1 + j] * _PLACE[j]
        whole = np.repeat(full, n_out)
        at = np.arange(len(out), dtype=np.int64) + np.repeat(first - begin, n_out)
        out[whole] = s[at[whole]]
    for m in range(1, k):
        rows = np.flatnonzero(counts == m)
        if len(rows):
            s = np.full(len(rows), m, np.uint64) * _PLACE[40]
            for j in range(m):
                s += h[first[rows] + j] * _PLACE[j]
            out[begin[rows]] = s
    return mix(out), n_out


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats, and their number per row."""
    if not len(values):
        return values, counts
    v = values.copy()
    ends = np.cumsum(counts)
    for i, j in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        v[i:j].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    keep[(ends - counts)[counts > 0]] = True
    left = np.concatenate(([0], np.cumsum(keep)))
    return v[keep], left[ends] - left[ends - counts]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each row's values; empty rows give 0."""
    out = np.zeros(len(counts), np.float64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], dtype=np.float64)
    return out


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column with `counts` values a row."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))

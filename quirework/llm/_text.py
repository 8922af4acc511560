"""Vectorised word handling over Arrow text buffers.

Words are found on the UTF-8 bytes: every class of separators used here is ASCII, so bytes of
multi-byte characters are always word bytes. A word's identity is a 64-bit fingerprint.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 19


def _return_freed_memory(least: int = 8 << 20) -> None:
    """Lets a worker's memory follow its present need: glibc gives blocks of that size back at once, and Arrow uses glibc."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, least)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 2 * least)  # M_TRIM_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())


_return_freed_memory()


def _table(word: np.ndarray) -> np.ndarray:
    """Byte -> lower-case byte inside a word, 0 outside; NUL inside a word becomes 0xFF, no UTF-8 byte."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    lut[0] = 255
    lut[~word] = 0
    return lut


_space = np.ones(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = False
#: words [^\x20\x09-\x0D]+
SPACED = _table(_space)
_alnum = np.ones(256, bool)
_alnum[:0x80] = False
_alnum[0x30:0x3A] = True
_alnum[0x61:0x7B] = True
_alnum[0x41:0x5B] = True  # lower-cased before the split
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = _table(_alnum)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, SLICE_BYTES * 2), base, U)
        step[0] = 1
        have = np.cumprod(step, dtype=U)
        if n <= SLICE_BYTES * 4:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def binary(column: pa.Array) -> pa.Array:
    """Text as large_binary; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    return column.cast(pa.large_binary())


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary array without copying."""
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs is not None else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) of runs of rows with about `most` bytes; a row stays whole."""
    data, offs = buffer_of(binary(column))
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, lut: np.ndarray, hashed: bool = True):
    """(start byte, end byte, fingerprint or None, word offsets by row) of the words of each row."""
    low = lut[data]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offs[:-1][offs[:-1] < len(data)]
        first[edge] = inside[edge]
        edge = offs[1:][offs[1:] > 0] - 1
        last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = None
    if hashed:
        total = np.zeros(len(data) + 1, U)
        np.cumsum(low * _power(BASE, len(data)), dtype=U, out=total[1:])
        h = mix((total[ends] - total[starts]) * _power(INVERSE, len(data) + 1)[starts])
    return starts, ends, h, np.searchsorted(starts, offs)


#: odd multipliers of a word's place in a shingle
PLACES = [U(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(64)]


def shingles(h: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the k-word shingles in order of place, and their offsets by row.

    A row with fewer than k words, but not none, has its whole sequence as one.
    """
    n = np.diff(woffs)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_offs = np.concatenate([[0], np.cumsum(count)])
    if not len(h):
        return np.zeros(0, U), out_offs
    m = len(h) - k + 1
    roll = np.zeros(max(m, 0), U)
    for j in range(k):
        roll += h[j : j + len(roll)] * PLACES[j]
    at = np.repeat(woffs[:-1] - out_offs[:-1], count) + np.arange(out_offs[-1])
    out = roll[np.minimum(at, max(m - 1, 0))] if m > 0 else np.zeros(out_offs[-1], U)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = U(0x5851F42D4C957F2D) * n[short].astype(U)
    for j in range(k - 1):
        has = n[short] > j
        whole[has] += h[woffs[short[has]] + j] * PLACES[j]
    out[out_offs[short]] = whole
    return mix(out), out_offs


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables that end where the columns `by` change; the batches come sorted by them, without nulls there."""
    held: list[pa.RecordBatch] = []  # rows of one group, perhaps with more to come
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in (batch.schema.get_field_index(x) for x in by)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = bool(held) and any(x[0] != held[-1].column(c)[-1].as_py() for x, c in zip(columns, by, strict=True))
        for x in columns:
            new[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            held.append(batch)
            continue
        if len(done := [*held, *([batch.slice(0, int(at[-1]))] if at[-1] else [])]):
            yield pa.Table.from_batches(done).combine_chunks()
        held = [batch.slice(int(at[-1]))]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()

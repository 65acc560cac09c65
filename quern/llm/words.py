"""Words of whole texts as arrays: boundaries, hashes and shingles of a batch at once.

A batch is the UTF-8 bytes of many texts end to end. Words are runs of bytes other than
0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a polynomial over random byte
values, read from one running sum, so no string is ever built.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is a slice of its own.
SLICE = 1 << 19

_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release() -> None:
    """Hand freed memory back: workers are used again by later stages, beside a JVM with its own needs."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE) + 1, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 2 * SLICE:
            _powers[base] = have
    return have[:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many spans, equal for equal contents and lengths."""
    n = len(values)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_BASE, n), out=run[1:])
    raw = (run[ends] - run[starts]) * powers(_BASE_INV, n + 1)[starts]
    return mix(raw ^ mix((ends - starts).astype(np.uint64), 7))


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``most`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        yield row, last, raw[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        row = last
    release()


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    #: words of document d are first[d]:first[d+1]
    first: np.ndarray


def words(raw: np.ndarray, offs: np.ndarray) -> Words:
    n = len(raw)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n + 1, bool)
    before[1:] = solid
    after = np.zeros(n + 1, bool)
    after[:n] = solid
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return Words(start, end, doc, span_hash(_BYTE[raw], start, end) if n else np.zeros(0, np.uint64), first)


_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the sorted distinct shingle hashes of document d are values[bounds[d]:bounds[d+1]].

    A text with fewer words than ``width`` has one shingle, its whole sequence; one without words has none.
    """
    w = words(raw, offs)
    count = np.diff(w.first)
    each = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(each)])
    doc = np.repeat(np.arange(len(count)), each)
    at = w.first[doc] + np.arange(bounds[-1]) - bounds[doc]
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        inside = j < count[doc]
        h += np.where(inside, w.hash[np.minimum(at + j, max(len(w.hash) - 1, 0))] if len(w.hash) else 0, np.uint64(j)) * (_PLACE[j % 5] + np.uint64(2 * (j // 5)))
    h = mix(h, 1)
    kept = np.ones(len(h), bool)
    for d in range(len(count)):
        lo, hi = bounds[d], bounds[d + 1]
        if hi - lo > 1:
            h[lo:hi].sort()
            kept[lo + 1 : hi] = h[lo + 1 : hi] != h[lo : hi - 1]
    left = np.concatenate([[0], np.cumsum(kept)])
    return h[kept], left[bounds]

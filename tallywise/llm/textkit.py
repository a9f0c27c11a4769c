"""Word and shingle hashes of Arrow text columns, computed by numpy over whole buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A word's hash is a polynomial over its
bytes modulo 2**64, finalised by an avalanche mix with its length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        x = np.full(max(n, 2 * len(_powers), 256), BASE, dtype=np.uint64)
        x[0] = 1
        _powers = np.multiply.accumulate(x)
    return _powers


def release() -> None:
    """Gives memory that is no longer used back to the system: Python workers stay, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at.astype(np.int64)


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer row stands alone."""
    data, at = raw(column)
    rows, lo = len(at) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    release()


#: Bytes that are hashed at once: hashing takes some 50 bytes for each.
HASHED = 1 << 18


def run_hashes(data: np.ndarray, inside: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte positions of runs of bytes; ``start`` marks the first byte of each, all ``inside``."""
    if len(data) <= HASHED:
        return _run_hashes(data, inside, start)
    marks = np.flatnonzero(start & inside)
    place = np.searchsorted(marks, np.arange(HASHED, len(data), HASHED))
    cuts = np.unique(np.concatenate(([0], marks[place[place < len(marks)]], [len(data)])))
    parts = [_run_hashes(data[a:b], inside[a:b], start[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    at = [p + a for (_, p), a in zip(parts, cuts[:-1], strict=True)]
    return np.concatenate([h for h, _ in parts]), np.concatenate(at)


def _run_hashes(data: np.ndarray, inside: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = np.flatnonzero(start[at])
    length = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, length)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[place]
    return mix(np.add.reduceat(terms, head) ^ mix(length.astype(np.uint64))), at[head]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the position of each row's first word (one more than rows)."""
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    start[firsts] = inside[firsts]
    hashes, at = run_hashes(LOWER[data], inside, start)
    return hashes, np.searchsorted(at, offsets)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position (fewer positions than words by n - 1)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += hashes[k : k + m] * powers(n + 1)[k + 1]
    return mix(total ^ np.uint64(n))


def shingles(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its n-word shingles in text order). With fewer words, the whole sequence is one; without words, none."""
    for lo, hi, data, offsets in pieces(column):
        hashes, first = words(data, offsets)
        grams = ngrams(hashes, n)
        for row in range(lo, hi):
            a, b = first[row - lo], first[row - lo + 1]
            yield row, grams[a : b - n + 1] if b - a >= n else ngrams(hashes[a:b], b - a) if b > a else grams[:0]

"""Vectorised hashing of words and shingles over Arrow string buffers.

The functions below work on the UTF-8 bytes of many rows at once, so that no Python object is made per word.
A word is a run of bytes other than space and tab..carriage return; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    n = 0
    up = down = np.zeros(0, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            size = max(n, CHUNK_BYTES + 65536)
            up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            if n > 4 * CHUNK_BYTES:  # one very long text: do not hold its tables for ever
                return up, down
            cls.up, cls.down, cls.n = up, down, size
        return cls.up, cls.down


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def segment_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each pair; codes are small non-negative integers."""
    up, down = _Powers.get(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_Q))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word, and for each row the range of its words."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    here, before = solid[1:-1], solid[:-2]
    start = np.flatnonzero(here & (~before | cut[:-1]))
    end = np.flatnonzero(here & (~solid[2:] | cut[1:])) + 1
    return segment_hash(_LOWER[data], start, end), start, end, np.searchsorted(start, offsets)


def _fold(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are left out."""
    n, factor = len(word_hashes) - k + 1, 1
    out = np.full(max(n, 0), k, np.uint64)
    for j in range(k):
        factor = factor * _Q % (1 << 64)
        out += word_hashes[j : j + n] * np.uint64(factor)
    return mix(out)


def shingle_rows(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a shorter row's whole sequence is its one shingle."""
    data, offsets = string_buffers(column)
    for lo, hi in chunks(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        h, _, _, bounds = words(part, off)
        grams = _fold(h, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield _fold(h[a:b], b - a)
            else:
                yield h[:0]

"""Bitmaps of hashes that let tasks leave out most of what an exact join would drop later.

Each hash sets three bits of sixteen for each key, so that about one other hash in two hundred passes; a hit means "maybe"
and a join always follows; a miss is certain.  A bitmap has at most ``MOST_BITS``.  More keys than that allows are cut into
parts by their highest bits, each with a bitmap and a pass of its own over what is filtered: however many keys there are, no
bitmap fills up, and one at a time is on the driver or in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the smallest and of the largest bitmap: 16 MB are the most that is broadcast.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Bits for each key, and those that it sets.
BITS_EACH, PROBES = 16, 3
#: Rows with whole texts are filtered in at most so many passes; beyond, moving the texts once is less than reading them again.
MOST_PASSES = 4


@dataclass(frozen=True)
class Bitmap:
    words: np.ndarray
    part: int = 0
    parts: int = 1


def _parts(keys: int) -> int:
    """How many bitmaps so many keys need: a power of two."""
    return 1 << max(0, -(-keys * BITS_EACH // MOST_BITS) - 1).bit_length()


def bitmap(table: DataFrame, column: str, part: int = 0, parts: int = 1, keys: int | None = None) -> Bitmap:
    """The bitmap of a long column of a written table, or of one of the parts of its values."""
    share = -(-(table.count() if keys is None else keys) // parts)
    size = min(max(1 << (BITS_EACH * share).bit_length(), LEAST_BITS), MOST_BITS)
    value = F.col(f"`{column}`")
    rows = table.where(F.shiftrightunsigned(value, 65 - parts.bit_length()) == part) if parts > 1 else table
    bits = [(value.bitwiseAND(F.lit((1 << 31) - 1)) + i * F.shiftrightunsigned(value, 32).bitwiseOR(F.lit(1))).bitwiseAND(F.lit(size - 1)) for i in range(PROBES)]
    rows = rows.select(F.explode(F.array(*bits)).alias("bit"))
    words = rows.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return Bitmap(out.view(np.uint64), part, parts)


def passes(table: DataFrame, column: str) -> Iterator[Bitmap]:
    """Bitmaps of all values of a long column of a written table, one after the other."""
    keys = table.count()
    parts = _parts(keys)
    for part in range(parts):
        yield bitmap(table, column, part, parts, keys)


def _here(bits: Bitmap, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes belong to the bitmap's part."""
    if bits.parts == 1:
        return np.ones(len(hashes), bool)
    return hashes.view(np.uint64) >> np.uint64(65 - bits.parts.bit_length()) == np.uint64(bits.part)


def held(bits: Bitmap, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the bitmap."""
    out = _here(bits, hashes)
    some = np.flatnonzero(out)
    h = hashes.view(np.uint64)
    for i in range(PROBES):  # what one bit rules out is not looked at again
        x = h[some]
        at = ((x & np.uint64((1 << 31) - 1)) + np.uint64(i) * (x >> np.uint64(32) | np.uint64(1))) & np.uint64(64 * len(bits.words) - 1)
        hit = (bits.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        out[some[~hit]] = False
        some = some[hit]
    return out


def maybe_in(bits: Bitmap, hashes: Column) -> Column:
    """``held`` as a column expression; only the hashes leave the JVM."""

    @F.arrow_udf("boolean")
    def run(hashes: pa.Array) -> pa.Array:
        return pa.array(held(bits, hashes.to_numpy()))

    return run(hashes)


def certainly_not_in(bits: Bitmap, hashes: Column) -> Column:
    """Of the bitmap's part, but not in it."""

    @F.arrow_udf("boolean")
    def run(hashes: pa.Array) -> pa.Array:
        hashes = hashes.to_numpy()
        return pa.array(_here(bits, hashes) & ~held(bits, hashes))

    return run(hashes)


def split(rows: DataFrame, hashes: Column, table: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be among the values of a long column of a written table, rows whose hash is not)."""
    keys = table.count()
    parts = _parts(keys)
    if parts > MOST_PASSES:
        return rows, rows.where("false")
    maybe = others = None
    for part in range(parts):
        bits = bitmap(table, column, part, parts, keys)
        yes, no = rows.where(maybe_in(bits, hashes)), rows.where(certainly_not_in(bits, hashes))
        maybe, others = (yes, no) if maybe is None else (maybe.unionAll(yes), others.unionAll(no))
    return maybe, others

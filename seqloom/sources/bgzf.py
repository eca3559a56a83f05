"""Blocks of blocked gzip files (BGZF), cut by Spark's text reader: the magic number of a block is its line separator."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged

#: Fixed values of the format: the first bytes of a block, and the name of the extra field that holds its size less 1.
MAGIC, SIZE_FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
#: Blocks of at most 64 KB that are handled together.
PART_BLOCKS = 256
BLOCKS = "file string, split long, part long, inner long, size long, z binary"


def _block_bytes(head: bytes) -> int | None:
    """The size of a block whose magic is followed by ``head``; None if it has no valid header."""
    if len(head) < 8:
        return None
    at, end = 8, 8 + struct.unpack_from("<H", head, 6)[0]
    while at + 4 <= min(end, len(head)):
        if head[at : at + 4] == SIZE_FIELD and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", head, at + 2)[0]
    return None


def joined(pieces: Iterator[tuple[str, int, bytes]]) -> Iterator[tuple[str, int, bytes | None]]:
    """(file, split, block) of what lies between magics.  A magic inside a block is told by the block's size.

    A file that does not start with the magic is one plain gzip stream.  Where blocks do not follow one another, as when
    a split starts inside a block that holds magics itself, there is a None for the rest of the split.
    """
    file, split, block, need = None, None, b"", 0  # need: the block's size, None to the end of the split, -1 broken

    def rest() -> Iterator[tuple[str, int, bytes | None]]:
        if need is None or need < 0 or need != len(block):
            yield file, split, block if need is None else None

    for f, s, data in pieces:
        if (f, s) != (file, split):
            yield from rest()
            file, split, block, need = f, s, b"", 0
            if s == 0:
                if data:
                    block, need = data, None if data[:2] == MAGIC[:2] else -1
                continue
        if need == -1:
            continue
        if need is None or len(block) < need:
            block += MAGIC + data
        else:
            block, need = MAGIC + data, _block_bytes(data) or -1
        if need is not None and 0 < need < len(block):
            need = -1
        elif need == len(block):
            yield file, split, block
    yield from rest()


def _rows(found: Iterator[tuple[str, int, bytes | None]]) -> Iterator[pa.RecordBatch]:
    out, held, place, n, inner = [], 0, None, 0, 0
    for file, split, z in found:
        if (file, split) != place:
            place, n, inner = (file, split), 0, 0
        size = -1 if z is None else struct.unpack("<I", z[-4:])[0]
        if size:
            out.append((file, split, n // PART_BLOCKS, inner, size, z))
            n, inner, held = n + 1, inner + size, held + len(z or b"")
        if held >= 4 << 20:
            yield _batch(out)
            out, held = [], 0
    yield _batch(out)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of BLOCKS that are not empty: ``inner`` is a block's place in the uncompressed bytes of its split, ``part`` a
    run of PART_BLOCKS blocks.  The rows are written, as splits follow the reader's settings.

    Files in which a split does not start at a block, or that are damaged, are read again whole, each in one task, and
    raise if their blocks do not follow one another there.
    """

    def split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(joined(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)))

    def file_blocks(file: str, data: bytes) -> Iterator[tuple[str, int, bytes]]:
        at = 0
        while at < len(data):
            need = _block_bytes(data[at + 4 : at + 24 + 65536]) if data[at : at + 4] == MAGIC else None
            if need is None or at + need > len(data):
                raise ValueError(f"{file}: damaged, or not gzip, at byte {at}.")
            yield file, 0, data[at : at + need]
            at += need

    def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(row for b in batches for c in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in file_blocks(*c))

    file = F.col("_metadata.file_path").alias("file")
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    found = staged(lines.select(file, F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("z")).mapInArrow(split_rows, BLOCKS), "blocks")
    odd = found.where("size < 0").select("file").distinct()
    if odd.isEmpty():
        return found
    whole = spark.read.format("binaryFile").load(path).select(file, "content").join(odd, "file").mapInArrow(file_rows, BLOCKS)
    return staged(found.join(odd, "file", "left_anti").unionByName(whole), "blocks")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["file", "split", "part", "inner", "size", "z"])


def unpacked(zs: list[bytes]) -> bytes:
    return b"".join(map(gzip.decompress, zs))

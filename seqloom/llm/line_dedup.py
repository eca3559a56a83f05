"""Removal of repeated lines by content-defined chunks.

A rolling hash over the hashes of two adjacent lines stands for the place between them.  The corpus says where chunks
end: a chunk goes on from one place to the next only if everywhere in the corpus the first one's hash is followed by the
second's and the second's preceded by the first's; the start and the end of a text count as neighbours of their own.  So
a boundary depends on nothing but the lines next to it, an insertion above moves none, and a passage starts and ends
chunks wherever other lines, or a part of it alone, surround it elsewhere.  Neighbouring chunks share the line at their
boundary, and every occurrence of a place lies in a whole occurrence of its chunk: no repeat of two lines or more is cut.

Chunks (two lines at least) whose hash occurs more than once are compared byte by byte; of equal ones the first by
(doc_id, place, digest of the text) stays and the lines of the others go.  So the first place of every line stays, and no run of two
lines that stood before is left but where removals brought lines together.  Only hashes travel for what occurs once: a
bitmap of bounded size tells the tasks which lines can matter, and the exact joins follow.

Defined results: null and empty texts stay as they are.  Rows without id are left alone and not compared.  Rows with
equal doc_id and equal text are one document; rows with equal doc_id and other texts are other documents.  Of chunks that
overlap their own first occurrence (three equal lines) the first stays whole.  A single line whose neighbours differ is
never removed, however often it occurs.  An empty table gives an empty one.  Texts are whole at any length.  Input
columns named like the three that are added are replaced; other columns, whatever their names, are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..bitmaps import Bitmap, held, passes
from .scratch import Scratch, quoted
from .textnum import chunks, mix, segment_hash, string_buffers

ADDED = ("n_lines", "n_removed_lines", "n_removed_chunks")
_Q = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of lines that leave a task at a time.
_FLUSH = 4 << 20
_DOC, _VERSION = ("doc_id", "version"), "decimal(38,0)"


def places(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Row (within the column), place, first and last hash around it, own hash, and the slices of its two lines.

    Yields for some rows at a time (row, place, hashes of the place before, here and after, line bounds), and the bytes.
    Hashes are 0 outside a text.
    """
    data, offsets = string_buffers(column)
    for lo, hi in chunks(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        # a line is its bytes with the line end; the last one of a text may lack it
        ends = np.unique(np.concatenate([np.flatnonzero(part == 10) + 1, off[1:][np.diff(off) > 0]]))
        if len(ends) < 2:
            continue
        starts = np.concatenate([[0], ends[:-1]])
        bare = ends - (part[ends - 1] == 10)
        row = np.searchsorted(off, starts, side="right") - 1
        first = np.searchsorted(starts, off[:-1])
        h = segment_hash(part, starts, bare)
        both = row[:-1] == row[1:]
        roll = np.where(both, mix(h[:-1] * _Q + h[1:]), np.uint64(0))
        before, after = np.concatenate([[np.uint64(0)], roll[:-1]]), np.concatenate([roll[1:], [np.uint64(0)]])
        at = np.flatnonzero(both)
        bounds = np.stack([starts[at], bare[at], starts[at + 1], bare[at + 1]], axis=1)
        hashes = np.stack([before[at], roll[at], after[at]], axis=1).view(np.int64)
        yield row[at] + lo, at - first[row[at]], hashes, bounds, part


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.where("doc_id is not null and text is not null")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), _version(text).alias("version"), text.alias("text"))


def _version(text: Column) -> Column:
    """Tells texts of equal doc_id apart: 120 bits of their SHA-256, as a number that hash tables and merge joins take."""
    part = lambda start: F.conv(F.substring(F.sha2(text, 256), start, 15), 16, 10).cast("decimal(19,0)")
    return (part(1) * F.lit(1 << 60).cast("decimal(19,0)") + part(16)).cast(_VERSION)


def _hashes(docs: DataFrame) -> DataFrame:
    """before, hash, after of every place between two lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, _, _ in places(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[:, i]) for i in range(3)], ["before", "hash", "after"])

    return docs.select("text").mapInArrow(run, "before long, hash long, after long")


def _marked(docs: DataFrame, bits: Bitmap) -> DataFrame:
    """doc_id, version, place, hash and both lines of the places whose hash the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, place, hashes, bounds, part in places(batch.column(2)):
                hit = np.flatnonzero(held(bits, hashes[:, 1]))
                size = np.cumsum(bounds[hit, 3] - bounds[hit, 0]) // _FLUSH
                for some in np.split(hit, np.flatnonzero(np.diff(size)) + 1) if len(hit) else ():
                    lines = [[part[a:b].tobytes() for a, b in bounds[some, i : i + 2].tolist()] for i in (0, 2)]
                    ids = [batch.column(i).take(pa.array(row[some])) for i in (0, 1)]
                    text = [pa.array(x, pa.binary()).view(pa.string()) for x in lines]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(place[some].astype(np.int32)), pa.array(hashes[some, 1]), *text], ["doc_id", "version", "place", "hash", "line", "below"])

    return docs.select(*_DOC, "text").mapInArrow(run, f"doc_id long, version {_VERSION}, place int, hash long, line string, below string")


def _chunks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, version, place, lines, content of every chunk whose places all occur more than once in the corpus."""
    counts = _hashes(docs).groupBy("hash").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{f.__name__}") for c in ("before", "after") for f in (F.min, F.max)))
    same = lambda c: F.col(f"{c}_min") == F.col(f"{c}_max")
    one = lambda c: F.when(same(c), F.col(f"{c}_min")).alias(c)
    repeated = scratch.keep(counts.where("n > 1").select("hash", one("before"), one("after")), "hashes")
    marked = None
    for bits in passes(repeated, "hash"):  # one pass, unless what is repeated needs several bitmaps
        part = _marked(docs, bits)
        marked = part if marked is None else marked.unionAll(part)
    marked = marked.join(repeated.hint("merge"), "hash")
    # a place goes on the chunk of the one above if each is the other's only neighbour
    above = Window.partitionBy(*_DOC).orderBy("place")
    last = lambda c: F.lag(c).over(above)
    goes_on = (last("place") == F.col("place")) | ((last("place") == F.col("place") - 1) & (last("after") == F.col("hash")) & (last("hash") == F.col("before")))
    start = F.last(F.when(~F.coalesce(goes_on, F.lit(False)), F.col("place")), ignorenulls=True).over(above.rowsBetween(Window.unboundedPreceding, 0))
    rows = marked.withColumn("start", start).groupBy(*_DOC, "start").agg(F.max("place").alias("last"), F.max_by("below", "place").alias("below"), F.array_sort(F.collect_set(F.struct("place", "line"))).alias("above"))
    content = F.concat_ws("\n", F.transform("above", lambda x: x["line"]), F.col("below"))
    return rows.select(*_DOC, F.col("start").alias("place"), (F.col("last") - F.col("start") + 2).alias("lines"), content.alias("content"))


def repeated_chunks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, version, place, lines of the chunks to remove: equal, byte by byte, to one that stands before them."""
    found = scratch.keep(_chunks(_texts(docs), scratch).withColumn("digest", F.xxhash64("content")), "chunks")
    # a decimal orders by (doc_id, place) and keeps the aggregation in its hash map
    rank = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("place")
    found = found.withColumn("rank", rank.cast("decimal(38,0)"))
    first = found.groupBy("digest", "content").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = scratch.keep(first.withColumn("chunk", F.monotonically_increasing_id()), "first")
    equal = scratch.keep(found.join(first.hint("merge"), ["digest", "content"]).select("chunk", *_DOC, "place", "lines", "rank", "first"), "equal")
    # of documents that share the first one's id the smallest version is the first; next to its chunk lies what overlaps it
    near = equal.where("rank <= first + 1")
    starts = scratch.keep(near.where("rank = first").groupBy("chunk").agg(F.min("version").alias("start")), "starts")
    others = near.join(starts, "chunk").where("version <> start")
    return equal.where("rank > first + 1").select(*_DOC, "place", "lines").unionByName(others.select(*_DOC, "place", "lines")).distinct()


def remove_repeated_lines(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` cleaned, and n_lines, n_removed_lines, n_removed_chunks added.

    The last counts runs of removed lines: chunks that share a line count as one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    drop = repeated_chunks(docs, scratch).groupBy(*(F.col(c).alias(f"_{c}") for c in _DOC)).agg(F.collect_list(F.struct("place", "lines")).alias("_drop"))
    drop = scratch.keep(drop, "drop")
    kept = [c for c in docs.columns if c not in ADDED and c != "text"]
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(quoted(c) for c in kept)).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("_doc_id"), _version(text).alias("_version"))
    # a merge join at every size: what has repeats grows with the corpus
    rows = rows.join(drop.hint("merge"), ["_doc_id", "_version"], "left").select("row", "text", "_drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total, removed_lines, removed_runs = [], [], [], []
            for old, cut in zip(batch.column(1), batch.column(2), strict=True):
                old, n, runs = old.as_py(), 0, 0
                lines = (old or "").count("\n") + bool(old and not old.endswith("\n"))
                if cut.is_valid:
                    gone = {i for x in cut.as_py() for i in range(x["place"], x["place"] + x["lines"])}
                    n, runs = len(gone), sum(i - 1 not in gone for i in gone)
                    new = "".join(line + "\n" for i, line in enumerate(old.removesuffix("\n").split("\n")) if i not in gone)
                    old = new if old.endswith("\n") else new[:-1]
                for column, value in zip((out, total, removed_lines, removed_runs), (old, lines, n, runs), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), *(pa.array(x, pa.int64()) for x in (total, removed_lines, removed_runs))], ["row", "text", *ADDED])

    fields = [StructField("row", rows.schema["row"].dataType), StructField("text", StringType()), *(StructField(c, LongType()) for c in ADDED)]
    out = rows.mapInArrow(run, StructType(fields))
    return out.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED), *ADDED)

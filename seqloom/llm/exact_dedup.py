"""Exact dedup through an index of cuckoo filters whose hits are verified on content.

Texts are equal if they are the same after every run of ASCII white space is made one space.  The index knows the digests
(SHA-256 of that text) of live contents.  They are dealt to buckets, and each bucket has a cuckoo filter: four 16-bit
fingerprints to a place, two places for each key, so keys can be put in and taken out.

*Insertion*: tasks combine equal digests and deal them by bucket; a bucket's filter answers for each whether it may be there,
and takes it in if not.  A miss is certainly new.  The digests of hits are candidates: the contents of their rows, and
those that the index stores for them, meet by digest and content and are compared as a whole.  So texts that occur once
never move, and a group of copies moves one text for each task.

*Deletion*: hits are verified in the same way before their fingerprints are taken out; what was not there cannot harm others.

*Overflow*: a filter that finds no place for a key is made anew at twice the size from the keys stored: those of this
insertion, which its task holds, or where it had older ones, those in the index's table.  Until that is done every key of
the bucket counts as a hit, so results never depend on a filter's state.

A kept index is a folder of generations: keys (digest, content, doc_id of what stays), contents gone, and the filters after
it, whose success file makes the generation count.  A step that fails leaves no trace but files that the next one replaces.

Defined results: null counts as the empty text.  The smallest id of a group stays; null ids come after all others, and rows
with the id that stays all stay.  Repeated rows are copies.  An empty table gives an empty one.  Texts are whole at any
length.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bitmaps import split
from .scratch import Scratch, importable
from .textnum import mix, string_buffers

#: Fingerprints at a place of a filter, places of a new one, and rounds of moving fingerprints before it is full.
SLOTS, LEAST_PLACES, MOST_ROUNDS = 4, 64, 200
#: Contents a bucket is made for, and the fewest buckets.
BUCKET_KEYS, LEAST_BUCKETS = 1 << 16, 256
#: Digests that a task combines at a time.
_COMBINED = 1 << 18
_DIGEST = 32
#: What a row asks of a bucket's filter.
_FILTER, _ADD, _REMOVE, _PROBE_ADD, _PROBE = range(5)
_OUT = "bucket int, kind int, data binary, full boolean, added boolean"


class CuckooFilter:
    """A set of 64-bit keys that may answer yes for others; ``table`` has SLOTS fingerprints a place, 0 for none."""

    def __init__(self, table: np.ndarray | None = None):
        self.table = np.zeros((LEAST_PLACES, SLOTS), np.uint16) if table is None else table

    def _marks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, first place) of each key."""
        return np.maximum(keys >> np.uint64(48), np.uint64(1)).astype(np.uint16), (keys & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, marks: np.ndarray, places: np.ndarray) -> np.ndarray:
        return places ^ (mix(marks) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        marks, one = self._marks(keys)
        at = lambda places: (self.table[places] == marks[:, None]).any(axis=1)
        return at(one) | at(self._other(marks, one))

    def add(self, keys: np.ndarray) -> bool:
        """Put keys in; if there is no place for all of them, none is put in and the answer is False."""
        before, (marks, places) = self.table.copy(), self._marks(keys)
        draw = np.random.default_rng(len(keys))
        for turn in range(MOST_ROUNDS):
            if not len(places):
                return True
            _, here = np.unique(places, return_index=True)  # one key at a place in each round
            free = self.table[places[here]] == 0
            some = free.any(axis=1)
            slot = np.where(some, free.argmax(axis=1), draw.integers(0, SLOTS, len(here)))
            moved = some | (turn > 0)  # the second place is tried before others make room
            at = places[here][moved], slot[moved]
            out = self.table[at]
            self.table[at] = marks[here][moved]
            marks[here[moved]] = out
            places[here] = self._other(marks[here], places[here])
            left = np.ones(len(places), bool)
            left[here[some]] = False
            marks, places = marks[left], places[left]
        self.table = before
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Take keys out that were put in."""
        marks, places = self._marks(keys)
        for mark, one, two in zip(marks.tolist(), places.tolist(), self._other(marks, places).tolist(), strict=True):
            place = one if (self.table[one] == mark).any() else two
            self.table[place, np.flatnonzero(self.table[place] == mark)[:1]] = 0

    @classmethod
    def of(cls, keys: np.ndarray, places: int) -> CuckooFilter:
        """All keys in a filter of at least so many places, doubled until they fit."""
        keys = np.unique(keys)
        while True:
            found = cls(np.zeros((places, SLOTS), np.uint16))
            if len(keys) <= found.table.size and found.add(keys):
                return found
            places *= 2


def _keys(data: pa.Array) -> np.ndarray:
    raw, _ = string_buffers(data)
    return np.ascontiguousarray(raw.reshape(-1, _DIGEST)[:, 8:16]).view(np.uint64).ravel()


class _Bucket:
    """One bucket's filter during a step.  ``stored``: its keys, as long as all of them are known here."""

    def __init__(self, number: int):
        self.number, self.filter, self.full = number, CuckooFilter(), False
        self.stored: list[np.ndarray] | None = []
        self.added: list[np.ndarray] = []
        self.hits: list[pa.Array] = []

    def add(self, keys: np.ndarray) -> None:
        if self.stored is not None:
            self.stored.append(keys)
        if not self.full and not self.filter.add(keys):
            if self.stored is None:
                self.full = True  # made anew from the table of keys, after this step
            else:
                self.filter = CuckooFilter.of(np.concatenate(self.stored), 2 * len(self.filter.table))

    def take(self, kind: int, data: pa.Array, again: np.ndarray) -> None:
        if kind == _FILTER:
            raw = data[0].as_py()
            if raw is not None:
                self.filter, self.stored = CuckooFilter(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()), None
            return
        keys = _keys(data)
        if kind == _ADD:
            self.add(keys)
        elif kind == _REMOVE:
            self.filter.remove(keys)
        elif self.full:
            self.hits.append(data)
        else:
            different, where, many = np.unique(keys, return_inverse=True, return_counts=True)
            known = self.filter.holds(different)
            hit = known | (many > 1) | (np.bincount(where, again) > 0)
            self.hits.append(data.filter(pa.array(hit[where])))
            if kind == _PROBE_ADD:
                new = different[~known]
                if self.stored is not None and known.any():  # no older keys: what this step has not added only looked known
                    new = different[~known | ~np.isin(different, np.concatenate(self.added))]
                self.add(new)
                self.added.append(new)

    def out(self) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "kind", "data", "full", "added"]
        yield pa.RecordBatch.from_arrays([pa.array([self.number], pa.int32()), pa.array([_FILTER], pa.int32()), pa.array([None if self.full else self.filter.table.tobytes()], pa.binary()), pa.array([self.full]), pa.array([False])], names)
        if self.hits and len(data := pa.concat_arrays(self.hits).unique()):
            n, added = len(data), np.isin(_keys(data), np.concatenate([np.zeros(0, np.uint64), *self.added]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number, np.int32)), pa.array(np.full(n, _PROBE, np.int32)), data, pa.array(np.zeros(n, bool)), pa.array(added)], names)


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows bucket, kind, data, again, sorted by bucket and kind: the filters after them, and the digests that hit."""
    now: _Bucket | None = None
    for batch in batches:
        bucket, kind = (batch.column(i).to_numpy() for i in (0, 1))
        again = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
            if lo == hi:
                continue
            if now is None or now.number != bucket[lo]:
                if now is not None:
                    yield from now.out()
                now = _Bucket(int(bucket[lo]))
            now.take(int(kind[lo]), batch.column(2).slice(lo, hi - lo), again[lo:hi])
    if now is not None:
        yield from now.out()


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, data, again: each digest of a task's rows once, for so many rows at a time."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        for part in pa.Table.from_batches(held).combine_chunks().group_by(["bucket", "data"]).aggregate([([], "count_all")]).to_batches():
            again = pa.array(part.column("count_all").to_numpy() > 1)
            yield pa.RecordBatch.from_arrays([part.column("bucket"), part.column("data"), again], ["bucket", "data", "again"])
        held.clear()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _COMBINED:
            yield from flush()
    if held:
        yield from flush()


def normalised(text: Column) -> Column:
    """Runs of white space as one space; single spaces, the most frequent runs, are left as they are."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket")


def _contents(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("content"))
    return rows.select("doc_id", "content", _digest(F.col("content")).alias("digest"))


class ExactIndex:
    """``path`` None: an index for one insertion, whose contents stay where they are."""

    def __init__(self, spark: SparkSession, path: str | None = None, scratch: Scratch | None = None):
        importable(spark)
        self.spark, self.path, self.scratch = spark, path, scratch or Scratch(spark, "exact")

    def _there(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def generations(self) -> int:
        n = 0
        while self.path and self._there(f"{self.path}/{n:06d}/filters/_SUCCESS"):
            n += 1
        return n

    def _table(self, n: int, name: str) -> DataFrame | None:
        path = f"{self.path}/{n:06d}/{name}"
        return self.spark.read.parquet(path) if self._there(f"{path}/_SUCCESS") else None

    def _filters(self) -> DataFrame | None:
        """bucket, data, buckets: the filters of the last generation."""
        n = self.generations()
        last = self._table(n - 1, "filters") if n else None
        return None if last is None or last.isEmpty() else last

    def live(self) -> DataFrame:
        """bucket, digest, content, doc_id of every content that is in the index."""
        keys = self.spark.createDataFrame([], "bucket int, digest binary, content string, doc_id long, since int")
        gone = self.spark.createDataFrame([], "digest binary, content string, until int")
        for n in range(self.generations()):
            if (part := self._table(n, "keys")) is not None:
                keys = keys.unionByName(part.withColumn("since", F.lit(n)))
            if (part := self._table(n, "gone")) is not None:
                gone = gone.unionByName(part.withColumn("until", F.lit(n)))
        gone = gone.groupBy("digest", "content").agg(F.max("until").alias("until"))
        # of a content's lives only the last can go on
        return keys.join(gone, ["digest", "content"], "left").where("since > coalesce(until, -1)").select("bucket", "digest", "content", "doc_id")

    def _run(self, *rows: DataFrame) -> DataFrame:
        """The filters after rows (bucket, kind, data, again), and the digests that hit."""
        asked = rows[0]
        for more in rows[1:]:
            asked = asked.unionByName(more)
        ordered = asked.select("bucket", "kind", "data", "again").repartition("bucket").sortWithinPartitions("bucket", "kind")
        return self.scratch.keep(ordered.mapInArrow(_step, _OUT), "step")

    def _asked(self, digests: DataFrame, kind: int, buckets: int) -> DataFrame:
        dealt = digests.select(_bucket(F.col("digest"), buckets), F.col("digest").alias("data")).mapInArrow(_combined, "bucket int, data binary, again boolean")
        return dealt.withColumn("kind", F.lit(kind))

    @staticmethod
    def _as_rows(filters: DataFrame) -> DataFrame:
        return filters.select("bucket", F.lit(_FILTER).alias("kind"), "data", F.lit(False).alias("again"))

    @staticmethod
    def _split(rows: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows whose digest may be one of those that hit, the others)."""
        return split(rows, F.xxhash64("digest"), seen, "hash")

    def _verified(self, docs: DataFrame, seen: DataFrame) -> DataFrame:
        """digest, content, first (id), n, stored (id), live: the contents of the rows whose digest hit."""
        rows, _ = self._split(_contents(docs), seen)
        # grouped before they are joined: a task hands on one row for all its copies
        groups = rows.groupBy("digest", "content").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(seen.select("digest"), "digest")
        if not self.generations():
            return groups.select("*", F.lit(None).cast("long").alias("stored"), F.lit(False).alias("live"))
        old = self.live().join(seen.select("digest"), "digest").select("digest", "content", F.col("doc_id").alias("stored"), F.lit(True).alias("live"))
        return groups.join(old, ["digest", "content"], "left").na.fill(False, ["live"])

    def insert(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest, keep_id, group_size, kept for every row; new contents are in the index afterwards.

        What the index holds already stays there, and none of its copies is kept.  group_size counts the rows of ``docs``.
        """
        rows = self.scratch.keep(_contents(docs).select("doc_id", "digest"), "rows")
        old = self._filters()
        buckets = old.first()["buckets"] if old is not None else max(LEAST_BUCKETS, -(-rows.count() // BUCKET_KEYS))
        found = self._run(*([self._as_rows(old)] if old is not None else []), self._asked(rows, _PROBE_ADD, buckets))
        seen = self.scratch.keep(found.where(F.col("kind") == _PROBE).select(F.col("data").alias("digest"), "added", F.xxhash64("data").alias("hash")), "seen")
        groups = self.scratch.keep(self._verified(docs, seen), "groups")
        if self.path:
            self._store(docs, found, seen, groups, buckets)
        return self._decided(docs, rows, seen, groups)

    def _decided(self, docs: DataFrame, rows: DataFrame, seen: DataFrame, groups: DataFrame) -> DataFrame:
        keep = F.when(F.col("n").isNull(), F.col("doc_id")).when(F.col("live"), F.col("stored")).otherwise(F.col("first"))
        kept = F.when(F.col("n").isNull(), True).otherwise(~F.col("live") & F.col("doc_id").eqNullSafe(F.col("first")))
        decided = lambda joined: joined.select("doc_id", "digest", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), kept.alias("kept"))
        rest, alone = self._split(rows, seen)
        alone = alone.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        several = self.scratch.keep(groups.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest"), "several")
        if several.isEmpty():
            return alone.unionByName(decided(rest.join(groups.drop("content"), "digest", "left")))
        # different contents of one digest are told apart by their text
        single = groups.join(several, "digest", "left_anti").drop("content")
        apart = decided(rest.join(several, "digest", "left_anti").join(single, "digest", "left"))
        together = decided(_contents(docs).join(several, "digest").join(groups, ["digest", "content"]))
        return alone.unionByName(apart).unionByName(together)

    def _store(self, docs: DataFrame, found: DataFrame, seen: DataFrame, groups: DataFrame, buckets: int) -> None:
        """The next generation: new contents in buckets, and filters that hold all of them."""
        now = f"{self.path}/{self.generations():06d}"
        maybe, once = self._split(_contents(docs), seen)
        once = once.unionByName(maybe.join(seen.select("digest"), "digest", "left_anti").select(*once.columns))
        new = once.select("digest", "content", "doc_id").unionByName(groups.where("not live").select("digest", "content", F.col("first").alias("doc_id")))
        new = new.select(_bucket(F.col("digest"), buckets), "digest", "content", "doc_id")
        new.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{now}/keys")
        keys = self.spark.read.parquet(f"{now}/keys")

        filters = found.where(F.col("kind") == _FILTER)
        late = groups.where("not live").join(seen.where("not added").select("digest"), "digest").select("digest").distinct()
        late = self.scratch.keep(late.select(_bucket(F.col("digest"), buckets), F.col("digest").alias("data")), "late")
        while not late.isEmpty() or not filters.where("full").isEmpty():
            full = filters.where("full").select("bucket")
            digests = keys.select("bucket", "digest").unionByName(self.live().select("bucket", "digest")).join(full, "bucket").distinct().select("bucket", F.col("digest").alias("data"))
            adding = late.join(full, "bucket", "left_anti").unionByName(digests).select("bucket", F.lit(_ADD).alias("kind"), "data", F.lit(False).alias("again"))
            filters, late = self._run(self._as_rows(filters), adding).where(F.col("kind") == _FILTER), late.limit(0)
        self._commit(filters, now, buckets)

    def _commit(self, filters: DataFrame, now: str, buckets: int) -> None:
        filters.select("bucket", "data", F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{now}/filters")

    def delete(self, docs: DataFrame) -> DataFrame:
        """Take the contents of ``docs`` out of the index; digest and doc_id of those that were in it."""
        nothing = self.spark.createDataFrame([], "digest binary, doc_id long")
        if (old := self._filters()) is None:
            return nothing
        buckets, now = old.first()["buckets"], f"{self.path}/{self.generations():06d}"
        found = self._run(self._as_rows(old), self._asked(_contents(docs).select("digest"), _PROBE, buckets))
        seen = self.scratch.keep(found.where(F.col("kind") == _PROBE).select(F.col("data").alias("digest"), F.xxhash64("data").alias("hash")), "seen")
        gone = self.scratch.keep(self._verified(docs, seen).where("live").select("digest", "content", F.col("stored").alias("doc_id")), "gone")
        gone.select("digest", "content").write.mode("overwrite").parquet(f"{now}/gone")
        others = self.live().join(seen.select("digest"), "digest").join(gone, ["digest", "content"], "left_anti").select("digest")
        digests = gone.select("digest").distinct().join(others, "digest", "left_anti")  # another content may have the same digest
        removing = digests.select(_bucket(F.col("digest"), buckets), F.lit(_REMOVE).alias("kind"), F.col("digest").alias("data"), F.lit(False).alias("again"))
        self._commit(self._run(self._as_rows(old), removing).where(F.col("kind") == _FILTER), now, buckets)
        return gone.select("digest", "doc_id")


def exact_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, by one insertion into an empty index."""
    found = ExactIndex(docs.sparkSession, scratch=scratch).insert(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

"""MinHash near-duplicate detection by an inverted join on signature coordinates.

Every document is posted under each (coordinate, value) pair of its MinHash signature.  Two documents can only reach
``min_matches`` equal coordinates if they also meet in the rarest postings of each, so

* *prefix*: a document keeps only its ``m - min_matches + 1`` rarest postings, ``m`` being the number of its postings
  that any other document shares (documents with fewer than ``min_matches`` of them have no partner at all);
* *skip*: the long lists left out are not merged; candidates are looked up in them by comparing the signatures.

Pairs with enough collisions are confirmed on their full shingle sets, and connected components follow from the links.
Documents with equal shingle sets are one class and take part once, and posting lists with the same members are merged.
Members of a list that is too long for one task are first compared to its smallest one; those that it is linked to need
no comparison among themselves, so a big group of near copies costs as many comparisons as it has members.  The others
of a long list are compared to all in square tiles of bounded size.  A tile returns at most one edge per member: neither
hot values nor big groups produce all their pairs as rows, and no candidate is dropped.

Defined results: null or blank text has an empty set and is linked with nothing.  Rows with equal ``doc_id`` are the
same document and so in one component.  A null ``doc_id`` is linked with nothing, its component is null and it is kept.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bitmaps import split
from .components import components
from .scratch import Scratch
from .textnum import mix, shingle_rows

#: Rows and shingles of one block of a long posting list; a tile holds two blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def signatures(docs: DataFrame, shingle_words: int, coordinates: int) -> DataFrame:
    """(doc_id, n_shingles, set_digest, sig): digest and signature are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(coordinates)
        salt = mix(np.arange(coordinates, dtype=np.uint64))
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for s in shingle_rows(batch.column(1), shingle_words):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    low = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
                    for i in range(0, len(s), 4096):
                        low = np.minimum(low, (s[i : i + 4096, None] * a + b).min(axis=0))
                    sigs.append(mix(low ^ salt).view(np.int64))
                else:
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_digest", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, sig array<long>")


def _links(shingle_words: int, percent: int, min_matches: int):
    """In one tile: compare signatures, then sets, and return each member with the smallest one that it reaches here."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        here, bi, bj = (x.as_py() for x in key)
        table = table.sort_by("rep")
        rep, block = table["rep"].to_numpy(), table["block"].to_numpy()
        n = len(rep)
        sigs = np.array(table["sig"].to_pylist(), dtype=np.int64)
        lists = [set(x) for x in table["lists"].to_pylist()]
        sets = list(shingle_rows(table["text"], shingle_words))
        size = np.array([len(s) for s in sets])
        # the root of each member, kept flat, as groups are small; what is settled has one already
        settled = table["settled"].to_numpy()
        root = np.unique(settled, return_index=True)[1][np.unique(settled, return_inverse=True)[1]]
        before = root.copy()
        for x in range(n - 1):
            y = np.arange(x + 1, n)
            y = y[root[y] != root[x]]
            if bi != bj:
                y = y[block[y] != block[x]]
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            if len(y):
                y = y[(sigs[y] == sigs[x]).sum(axis=1) >= min_matches]
            for z in y.tolist():
                if root[z] == root[x] or min(lists[x] & lists[z]) != here:
                    continue
                both = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                if 100 * both >= percent * (size[x] + size[z] - both):
                    lo, hi = sorted((root[x], root[z]))
                    root[root == hi] = lo
        linked = np.flatnonzero(root != before)
        return pa.table({"a": rep[linked], "b": rep[root[linked]]})

    return run


def _confirmed(shingle_words: int, percent: int):
    """Rows (rep, center) of (rep, center, text, center_text) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            keep = []
            for center, text, own in zip(batch.column(1).to_pylist(), batch.column(3), shingle_rows(batch.column(2), shingle_words), strict=True):
                if center != last:
                    last, other = center, next(shingle_rows(pa.array([text.as_py()], pa.string()), shingle_words))
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _maybe(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents that may be among ``ids`` (written): the others' texts are not shuffled."""
    return split(docs, F.xxhash64("doc_id"), ids.select(F.xxhash64("doc_id").alias("hash")), "hash")[0]


def _stars(docs: DataFrame, members: DataFrame, shingle_words: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """members (value, rep) of long lists -> their confirmed links to each list's smallest member, and (value, center)."""
    centers = scratch.keep(members.groupBy("value").agg(F.min("rep").alias("center")), "centers")
    pairs = scratch.keep(members.join(centers, "value").where("rep <> center").select("rep", "center").distinct(), "star-pairs")
    ids = scratch.keep(pairs.select(F.col("rep").alias("doc_id")).unionAll(pairs.select(F.col("center").alias("doc_id"))).distinct(), "star-ids")
    texts = scratch.keep(_maybe(docs, ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "star-texts")
    rows = pairs.join(texts.toDF("rep", "text"), "rep").join(texts.toDF("center", "center_text"), "center").sortWithinPartitions("center")
    links = rows.select("rep", "center", "text", "center_text").mapInArrow(_confirmed(shingle_words, percent), "a long, b long")
    return scratch.keep(links, "star-links"), centers


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, coordinates: int = 32, min_matches: int | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * |intersection| >= percent * |union|`` of their distinct shingles.  ``min_matches``
    is the collision threshold for candidates; by default 0.6 of the expected number at the similarity asked for.  With 32
    coordinates a pair right at the threshold is then missed about once in a million at 80 to 90 percent, in 7,000 at 70,
    1,100 at 60 and 290 at 50: ask for more coordinates there.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    matches = min_matches or max(1, int(0.6 * percent / 100 * coordinates))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(signatures(docs, shingle_words, coordinates), "signatures")
    usable = signed.where("set_digest is not null and doc_id is not null")

    # one class per set of shingles; its representative carries the signature
    # (written first, so that the join has its own exchange on both sides and a set that very many share is split)
    reps = scratch.keep(usable.groupBy("set_digest").agg(F.min("doc_id").alias("rep")), "reps")
    member = scratch.keep(signed.select("doc_id", "n_shingles", "set_digest").join(reps, "set_digest", "left"), "members")
    classes = usable.join(reps, ["set_digest"]).where("doc_id = rep").dropDuplicates(["set_digest"]).select("rep", "set_digest", "n_shingles", "sig")
    classes = scratch.keep(classes, "classes")

    # postings under (coordinate, value); values nobody shares cannot collide
    post = classes.select("set_digest", F.explode("sig").alias("value"))
    # (written, like the blocks below, so that a value that very many have is split in the join)
    shared = scratch.keep(post.groupBy("value").agg(F.count("*").alias("f")).where("f > 1"), "shared")
    lists = post.join(shared, "value").groupBy("set_digest").agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("l")).where(F.size("l") >= matches)
    prefix = lists.select("set_digest", F.explode(F.slice("l", F.lit(1), F.size("l") - F.lit(matches - 1))).alias("p")).select("set_digest", F.col("p.value").alias("value"))
    prefix = scratch.keep(prefix.join(classes.select("set_digest", "n_shingles"), "set_digest"), "prefix")

    # one of the lists that hold the same members is enough
    h = F.xxhash64("set_digest")
    stats = prefix.groupBy("value").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.bit_xor(h).alias("h1"), F.bit_xor(F.xxhash64(h, F.lit(7))).alias("h2")).where("n > 1")
    stats = stats.groupBy("n", "weight", "h1", "h2").agg(F.min("value").alias("value"))
    members = scratch.keep(prefix.join(stats.select("value", "n", "weight"), "value").join(classes.select("set_digest", "rep"), "set_digest"), "listed")
    too_long = (F.col("n") > BLOCK_ROWS) | (F.col("weight") > BLOCK_SHINGLES)
    long_lists = members.where(too_long).select("value", "rep")
    if long_lists.isEmpty():
        stars = None
        members = members.withColumns({"settled": F.col("rep"), "done": F.lit(False)})
    else:
        stars, centers = _stars(docs, long_lists, shingle_words, percent, scratch)
        label = scratch.keep(components(stars, scratch), "settled")
        named = lambda df, key, out: df.join(label.toDF(key, "_label"), key, "left").withColumn(out, F.coalesce("_label", key)).drop("_label")
        members = named(members, "rep", "settled").join(named(centers, "center", "main"), "value", "left")
        members = members.withColumn("done", F.coalesce(F.col("settled") == F.col("main"), F.lit(False)))

    # members that are not done meet all of their list, those that are done only these
    size = lambda which: F.ceil(F.greatest(F.sum(which.cast("int")) / BLOCK_ROWS, F.sum(F.when(which, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    blocks = members.groupBy("value").agg(size(~F.col("done")).alias("open"), size(F.col("done")).alias("shut")).where("open > 0")
    blocks = scratch.keep(blocks, "blocks")
    mine = F.when(F.col("done"), F.col("open") + F.pmod(F.xxhash64("set_digest", "value"), F.greatest("shut", F.lit(1)))).otherwise(F.pmod(F.xxhash64("set_digest", "value"), F.greatest("open", F.lit(1))))
    others = F.col("open") + F.when(F.col("done"), 0).otherwise(F.col("shut"))
    placed = members.join(blocks, "value").groupBy("set_digest").agg(
        F.collect_list("value").alias("lists"), F.min("settled").alias("settled"), F.collect_list(F.struct("value", others.alias("others"), mine.cast("int").alias("block"))).alias("places")
    )
    placed = scratch.keep(placed.join(classes, "set_digest"), "placed")

    texts = _maybe(docs, placed.select(F.col("rep").alias("doc_id"))).join(placed.select(F.col("rep").alias("doc_id"), "set_digest", "lists", "settled", "places", "sig"), "doc_id")
    tiles = texts.select(F.col("doc_id").alias("rep"), "text", "lists", "settled", "sig", F.explode("places").alias("p")).select(
        "rep", "text", "lists", "settled", "sig", "p.value", "p.block", F.explode(F.sequence(F.lit(0), F.col("p.others") - 1)).alias("other")
    )
    tiles = tiles.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other")
    edges = tiles.groupBy("value", "bi", "bj").applyInArrow(_links(shingle_words, percent, matches), "a long, b long")
    edges = edges if stars is None else edges.unionAll(stars)
    # a doc_id that has several texts ties their classes
    ties = member.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionAll(ties), scratch)
    out = member.withColumn("at", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))).join(found.withColumnRenamed("id", "at"), "at", "left")
    component = F.coalesce("component_id", "at")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size: class c holds those of 2^c to 2^(c+1) - 1 shingles.  For each class that occurs,
documents are cut into overlapping blocks of 2^(c+2) shingles, so that an item inside a document of any length lies in
some block of a size near its own, where its MinHash values are likely to be the block's.  Values are joined for each of
``functions`` hash functions, and every (document, item) pair that meets is verified by exact containment in the whole
document: ``100 * |item & document| >= percent * |item|`` over distinct shingles.

Items of fewer words than a shingle are searched as they are: the document must hold their words in a row.

Defined results: items and documents without words match nothing; documents shorter than a shingle only match short
items; rows without doc_id or item_id are not compared; documents that share an id count as contaminated if one is;
repeated items give a row each, repeated rows of a document one; empty tables give an empty one; texts are whole at any
length; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bitmaps import Bitmap, held, passes, split
from .minhash_dedup import _family
from .scratch import Scratch
from .textnum import _fold, chunks, mix, string_buffers, words

_SHORT = 1 << 20  # numbers the searches for short items apart from the size classes


def _grams(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row its word hashes and the hashes of its k-word shingles in order."""
    data, offsets = string_buffers(column)
    for lo, hi in chunks(offsets):
        h, _, _, bounds = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        grams = _fold(h, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield h[a:b], grams[a : max(a, b - k + 1)]


def _salt(kind: int, functions: int) -> np.ndarray:
    return mix(np.arange(functions, dtype=np.uint64) + np.uint64(kind * 65537 + 1))


def _item_keys(k: int, functions: int):
    a, b = _family(functions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, keys = [], []
            for w, g in _grams(batch.column(1), k):
                if len(g):
                    kind.append(len(np.unique(g)).bit_length() - 1)
                    keys.append(mix((np.unique(g)[:, None] * a + b).min(axis=0) ^ _salt(kind[-1], functions)).view(np.int64))
                elif len(w):
                    kind.append(_SHORT + len(w))
                    keys.append(mix(_fold(w, len(w)) ^ _salt(kind[-1], 1)).view(np.int64))
                else:
                    kind.append(None)
                    keys.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kind, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["item", "kind", "keys"])

    return run


def _document_keys(k: int, functions: int, kinds: list[int], bits: Bitmap):
    """Keys of the blocks of every document that the bitmap holds."""
    a, b = _family(functions)
    classes, short = sorted(c for c in kinds if c < _SHORT), [c - _SHORT for c in kinds if c >= _SHORT]

    def of(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        found = [mix(_fold(w, n) ^ _salt(_SHORT + n, 1)) for n in short if len(w) >= n]
        if len(g) and classes:
            # minima over pieces of the smallest stride, then over ever longer blocks
            step = 2 << classes[0]
            pieces = np.arange(0, len(g), step)
            low = np.empty((functions, len(pieces)), np.uint64)
            for j in range(functions):
                low[j] = np.minimum.reduceat(g * a[j] + b[j], pieces)
            c = classes[0]
            while True:
                if c in kinds:
                    block = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
                    found.append(mix(block ^ _salt(c, functions)[:, None]).ravel())
                c += 1
                if c > classes[-1]:
                    break
                low = np.minimum.reduceat(low, np.arange(0, low.shape[1], 2), axis=1)
        keys = np.concatenate(found) if found else w[:0]
        return np.unique(keys[held(bits, keys)]).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [of(w, g) for w, g in _grams(batch.column(1), k)]
            size = np.array([len(x) for x in keys])
            some = np.flatnonzero(size)
            flat = np.concatenate([keys[i] for i in some]) if len(some) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(some, size[some]))), pa.array(flat)], ["doc_id", "key"])

    return run


def _contained(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, w, grams = object(), None, None
        for batch in batches:
            total, common = [], []
            for text, (iw, ig) in zip(batch.column(2), _grams(batch.column(3), k), strict=True):
                text = text.as_py()
                if text != last:
                    last, (w, grams) = text, next(_grams(pa.array([text], pa.string()), k))
                    grams = np.unique(grams)
                if len(ig):
                    item = np.unique(ig)
                    common.append(len(np.intersect1d(item, grams, assume_unique=True)))
                    total.append(len(item))
                else:
                    common.append(int(len(w) >= len(iw) > 0 and bool((_fold(w, len(iw)) == _fold(iw, len(iw))[0]).any())))
                    total.append(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(common, pa.int64())], ["doc_id", "item", "n_item", "n_common"])

    return run


def contaminations(docs: DataFrame, items: DataFrame, shingle_words: int = 5, percent: int = 80, functions: int = 48, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, item, n_item, n_common) for every document and every text of an item that it contains, and (item_id, item)."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    # items with one text are one: it is searched for and compared once
    named = scratch.keep(named.withColumn("item", F.sha2("text", 256)), "named")
    items = scratch.keep(named.groupBy("item").agg(F.first("text").alias("text")), "texts")
    keyed = items.select("item", "text").mapInArrow(_item_keys(shingle_words, functions), "item string, kind int, keys array<long>").where("kind is not null")
    keyed = scratch.keep(keyed, "items")
    kinds = [r.kind for r in keyed.select("kind").distinct().collect()]  # one for each size class
    posted = scratch.keep(keyed.select("item", F.explode("keys").alias("key")).distinct(), "postings")
    pairs = None
    for bits in passes(posted, "key"):  # one pass over the documents, unless the items' keys need several bitmaps
        found = docs.mapInArrow(_document_keys(shingle_words, functions, kinds, bits), "doc_id long, key long")
        part = scratch.keep(found.join(posted, "key").select("doc_id", "item").distinct(), "candidates")
        pairs = part if pairs is None else pairs.unionAll(part).distinct()
    # only texts that may be candidates are shuffled
    docs = split(docs, F.xxhash64("doc_id"), pairs.select(F.xxhash64("doc_id").alias("hash")), "hash")[0]
    rows = pairs.join(items.select("item", F.col("text").alias("other")), "item").join(docs, "doc_id")
    checked = rows.select("doc_id", "item", "text", "other").mapInArrow(_contained(shingle_words), "doc_id long, item string, n_item long, n_common long")
    checked = checked.where(F.col("n_common") * 100 >= F.col("n_item") * percent)
    return checked.groupBy("doc_id", "item").agg(F.max("n_item").alias("n_item"), F.max("n_common").alias("n_common")), named.select("item_id", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, shingle_words: int = 5, percent: int = 80, functions: int = 48, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, item_id, n_item, n_common: every document that contains a test item, once for each item."""
    found, named = contaminations(docs, items, shingle_words, percent, functions, scratch)
    return found.join(named, "item").select("doc_id", "item_id", "n_item", "n_common")

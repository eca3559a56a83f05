"""Language identification by rank-order profiles.

A language's profile is its ``profile_size`` most frequent letter n-grams (1 to 3 letters, words padded by a blank) in
order.  A document's own most frequent n-grams, in order, are compared to each profile: an n-gram costs the number of
places between its two ranks, or ``profile_size`` if the profile lacks it, and the language with the smallest sum wins
(ties: the smaller name).

Profiles are fitted on a bounded sample of labelled rows: about ``train_docs`` documents for each language, taken by a
hash of their ids and texts.  They are the only thing that reaches the driver: ``profile_size`` n-grams for each language.

Defined results: ``und`` with score 0 for null text, text without a letter, or if there is nothing to learn from.
Repeated rows each give a row.  An empty table gives an empty one.  Texts are whole at any length.  Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bpe import text_groups
from .scratch import importable

UNKNOWN = "und"
#: Below this a text is in none of the languages: other scripts have 0, held-out documents of sf0.1 0.45 at least.
LEAST_SCORE = 0.25
#: Text taken at a time: a character needs some forty bytes on the way.
GROUP_BYTES = 1 << 20
#: Labels beyond which the column is taken for something else; the profiles of all of them reach the driver.
MOST_LANGUAGES = 5000
_BITS = 21  # of a code point
_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def ngram_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of each text, packed into integers; both empty if the text has no letter."""
    lower = [t.lower() for t in texts]
    code = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in lower])
    code = np.where(_alpha()[code], code, 32)
    solid = code != 32
    keep = solid | np.concatenate([[True], solid[:-1]])
    keep[ends - 1] = True  # each text ends in a blank of its own
    keep[: 1 if len(keep) else 0] = True
    bounds = np.concatenate([[0], np.cumsum(keep)[ends - 1]])
    code = np.concatenate([[32], code[keep]])  # a blank before the first text
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        c = code[lo : hi + 1].copy()
        c[0] = 32
        letter = c != 32
        if not letter.any():
            yield code[:0], code[:0]
            continue
        one = c[letter]
        two = (c[:-1] << _BITS | c[1:])[letter[:-1] | letter[1:]]
        three = ((c[:-2] << _BITS | c[1:-1]) << _BITS | c[2:])[letter[1:-1]]
        yield np.unique(np.concatenate([one, two, three]), return_counts=True)


def top(grams: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent in order; ties by n-gram."""
    if len(grams) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")[:n]]  # np.unique has sorted the n-grams


class RankProfiles:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.rank = np.full((len(self.grams), len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.grams, profiles[name]), j] = np.arange(len(profiles[name]))

    def best(self, grams: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        own = top(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        rank = np.where((self.grams[at] == own)[:, None], self.rank[at], -1)
        place = np.arange(len(own))[:, None]
        distance = np.where(rank >= 0, np.abs(rank - place), self.size).sum(axis=0)
        j = int(np.argmin(distance))
        return self.names[j], max(0.0, 1.0 - float(distance[j]) / (self.size * len(own)))

    def like_any(self, grams: np.ndarray, counts: np.ndarray) -> float:
        """The greatest score, each language by the size of its own profile: as many n-grams, at that cost for each it lacks.

        A full profile gives the score of ``best``.
        """
        own, most = top(grams, counts, self.size), 0.0
        for j in range(len(self.names)) if len(own) else ():
            size = int((self.rank[:, j] >= 0).sum())
            some = own[:size]
            at = np.minimum(np.searchsorted(self.grams, some), len(self.grams) - 1)
            rank = np.where(self.grams[at] == some, self.rank[at, j], -1)
            distance = np.where(rank >= 0, np.abs(rank - np.arange(len(some))), size).sum()
            most = max(most, 1.0 - float(distance) / (size * len(some)))
        return most


def held_out(folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def fit_profiles(labelled: DataFrame, profile_size: int = 300, train_docs: int = 2000) -> dict[str, list[int]]:
    """Profiles of the languages in rows doc_id, text, lang; rows with a null are not used."""
    importable(labelled.sparkSession)
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    totals = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"More than {MOST_LANGUAGES} labels: that is no column of languages.")
    totals = F.broadcast(labelled.sparkSession.createDataFrame(totals, "lang string, n long"))  # of checked size
    share = F.lit(float(train_docs)) / F.col("n")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(totals, "lang").where(draw < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lo = batch.column(0).to_pylist(), 0
            for texts in text_groups(batch.column(1), GROUP_BYTES):
                parts: dict[str, list] = {}
                for lang, x in zip(langs[lo : lo + len(texts)], ngram_counts(texts), strict=True):
                    parts.setdefault(lang, []).append(x)
                lo += len(texts)
                for lang, xs in parts.items():
                    grams, where = np.unique(np.concatenate([g for g, _ in xs]), return_inverse=True)
                    counts = np.bincount(where, np.concatenate([c for _, c in xs]), len(grams)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("place", place).where(F.col("place") <= profile_size).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "gram"))).alias("p"))
    return {r.lang: [x.gram for x in r.p] for r in best.collect()}


def identify(docs: DataFrame, profiles: dict[str, list[int]], profile_size: int = 300) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score put first; columns of those names are replaced."""
    importable(docs.sparkSession)
    model = RankProfiles(profiles, profile_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for texts in text_groups(batch.column(1), GROUP_BYTES):
                found = [model.best(g, c) for g, c in ngram_counts(texts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64()), batch.column(0).slice(lo, len(texts))], ["lang_pred", "score", "row"]
                )
                lo += len(texts)

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in kept)).alias("row"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("row", rows.schema["row"].dataType)]))
    return out.select("lang_pred", "score", "row.*")


def in_a_language(docs: DataFrame, profile_size: int = 300, train_docs: int = 2000, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text has a letter and is like one of the languages of the labelled rows: a score of ``least`` or more.

    A language whose rows do not fill its profile is held to the n-grams it has, so a few rows of a new label neither reject
    texts of their own language nor keep those of others.  Texts are not rejected by what was not learned: letters alone
    count where no language has a full profile.
    """
    importable(docs.sparkSession)
    profiles = fit_profiles(docs, profile_size, train_docs)
    model, judge = RankProfiles(profiles, profile_size), any(len(p) >= profile_size for p in profiles.values())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for texts in text_groups(batch.column(at), GROUP_BYTES):
                keep += [len(g) > 0 and (not judge or model.like_any(g, c) >= least) for g, c in ngram_counts(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, profile_size: int = 300, train_docs: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred, score: profiles are learned from the rows that are not held out."""
    profiles = fit_profiles(docs.where(~held_out()), profile_size, train_docs)
    return identify(docs.select("doc_id", "text"), profiles, profile_size).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

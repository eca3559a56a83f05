"""How far the sources of a language differ in their words, by exact arithmetic on deduplicated count columns.

Terms are runs of ASCII letters and non-ASCII characters, A-Z as a-z.  A language keeps the terms that at least ``least_docs``
of its documents have; V is their number.  For a group (a source of a language, or the whole language) with N occurrences
of kept terms, a term's share is p = 1 + floor(10^9 * (count + 1) / (N + V)).  Against the share q of another group a
term counts f = floor((p - q)^2 / q).

*Counting*: tasks count terms in tables of bounded size and hand on a row for each term and source, never a word each.

*Pairs of sources*: terms with the same counts in the same sources (the same sparse vector) are one vector with a multiplicity.
For each vector only pairs of sources that both have it are evaluated, once, times the multiplicity.  All other terms
follow from their counts alone: with g(x, y) the value of counts x and y, a pair's sum is
sum over both (g(x, y) - g(x, 0) - g(0, y) + g(0, 0)) + sum over the one (g(x, 0)) + sum over the other (g(0, y))
+ (V - terms of the one - terms of the other) * g(0, 0), where the single sums run over different counts, not terms.

*Terms of a source*: those more frequent in it than in its language, the ``top`` greatest values.

Defined results: null text, lang and source are ''.  Every group that occurs has its pairs, also without a term, with
value 0 if V is 0.  Each row is a document: repeated rows count each.  An empty table gives an empty one.  Texts are whole
at any length.  Other columns are not read.  A vector has at most an entry for each source of its language, and the
result a row for each pair of sources: both are as many as there are names of sources, not documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, importable
from .textnum import string_buffers

#: Bytes of a term: ASCII letters and all bytes of non-ASCII characters.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Different terms of groups that a task holds before it hands on their counts, about 100 bytes each.
TASK_TERMS = 500_000
#: Bytes of a text looked at together.
PIECE_BYTES = 1 << 20
#: Pairs of sources evaluated together.
BLOCK_PAIRS = 1 << 18
SCALE = 1_000_000_000


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that no term crosses."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE_BYTES
        while hi < len(text) and (_TERM.match(text[hi - 1 : hi]) and _TERM.match(text[hi : hi + 1])):
            hi += 1
        yield text[lo:hi]
        lo = hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, n_docs; the empty term stands for the group itself.

    The documents that have a term are counted for its language, and go with the first of its sources.
    """
    counts: dict[tuple[str, str], Counter] = {}
    n_docs: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in counts.items():
            terms, docs = [b"", *n], n_docs[lang]
            size = len(terms)
            columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.binary()).view(pa.string()), pa.array([0, *n.values()], pa.int64())]
            for lo in range(0, size, 1 << 15):
                part = [c.slice(lo, 1 << 15) for c in columns]
                yield pa.RecordBatch.from_arrays([*part, pa.array([docs.pop(t, 0) for t in terms[lo : lo + (1 << 15)]], pa.int64())], ["lang", "source", "term", "n", "n_docs"])
        counts.clear()
        n_docs.clear()

    for batch in batches:
        data, offsets = string_buffers(batch.column(2))
        for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            n, docs = counts.setdefault(group, Counter()), n_docs.setdefault(group[0], Counter())
            seen: set[bytes] = set()
            for piece in _pieces(data[offsets[i] : offsets[i + 1]].tobytes().translate(_LOWER)):
                terms = _TERM.findall(piece)
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            if sum(map(len, counts.values())) >= TASK_TERMS:
                yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, term, n_lang, n_docs, column (source, n); the empty term's column has every group of the language.

    Terms are dealt once: what a term has in its sources is summed and gathered in the same task.
    """
    importable(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(plain("lang"), plain("source"), plain("text")).mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    each = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    column = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("column")
    return each.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("n_docs"), column)


def _share(count: Column, total: Column) -> Column:
    """p of a count in a group whose N + V is ``total``; the product of a great count does not fit in 64 bits."""
    wide = F.call_function("div", (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(19,0)"))
    return F.when(count < 9 * SCALE, F.call_function("div", (count + 1) * SCALE, total)).otherwise(wide) + 1


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """As ``_share``, by long division, three decimal digits at a time."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, item, value: what vectors give to pairs that both have them, against zero counts in one or both."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lang, langs = langs.indices.to_numpy().astype(np.int64), langs.dictionary
        vectors, many = batch.column(1), batch.column(2).to_numpy()
        bounds = vectors.offsets.to_numpy().astype(np.int64)
        names, n, total = (vectors.values.field(i) for i in range(3))
        names = names.dictionary_encode()
        code, names = names.indices.to_numpy().astype(np.int64), names.dictionary
        n, total = n.to_numpy(), total.to_numpy()
        p, zero = shares(n, total), shares(np.zeros_like(n), total)
        size = np.diff(bounds)
        for k in np.unique(size[size > 1]).tolist():
            alike = np.flatnonzero(size == k)
            for rows in np.array_split(alike, -(-len(alike) * k * k // BLOCK_PAIRS)) if k * k <= BLOCK_PAIRS else alike[:, None]:
                at = bounds[rows][:, None] + np.arange(k)
                for first in np.array_split(np.arange(k), -(-len(rows) * k * k // BLOCK_PAIRS)):  # very many sources in parts
                    one, two = np.broadcast_arrays(at[:, first, None], at[:, None, :])
                    which = np.broadcast_to(rows[:, None, None], one.shape)[one != two]
                    one, two = one[one != two], two[one != two]
                    value = _floor(p[one], p[two]) - _floor(p[one], zero[two]) - _floor(zero[one], p[two]) + _floor(zero[one], zero[two])
                    keys, where = np.unique((lang[which] * len(names) + code[one]) * len(names) + code[two], return_inverse=True)
                    sums = np.zeros(len(keys), np.int64)
                    np.add.at(sums, where, value * many[which])
                    picked = (langs.take(pa.array(keys // len(names) ** 2)), names.take(pa.array(keys // len(names) % len(names))), names.take(pa.array(keys % len(names))))
                    yield pa.RecordBatch.from_arrays([*picked, pa.array(sums)], ["lang", "source", "item", "value"])


def _floor(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _kept_terms(docs: DataFrame, least_docs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, term, n_lang, column), and for every group (lang, source, total, total_lang, n_terms, n_kept)."""
    counts = scratch.keep(term_counts(docs).where((F.col("n_docs") >= least_docs) | (F.col("term") == "")).drop("n_docs"), "terms")
    terms = counts.where("term <> ''")
    of_group = terms.select("lang", F.inline("column")).groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("n_terms"))
    of_lang = terms.groupBy("lang").agg(F.sum("n_lang").alias("n_lang"), F.count("*").alias("n_kept"))
    groups = counts.where("term = ''").select("lang", F.explode("column.source").alias("source")).join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0)
    groups = groups.select("lang", "source", (F.col("n") + F.col("n_kept")).alias("total"), (F.col("n_lang") + F.col("n_kept")).alias("total_lang"), "n_terms", "n_kept")
    return terms, scratch.keep(groups, "groups")


def _pairs(terms: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source, item, value for every two sources of a language."""
    groups = groups.drop("total_lang")
    vectors = terms.where(F.size("column") > 1).groupBy("lang", "column").agg(F.count("*").alias("many"))
    vectors = scratch.keep(vectors.withColumn("vector", F.monotonically_increasing_id()), "vectors")
    entries = vectors.select("vector", "lang", "many", F.inline("column")).join(groups.select("lang", "source", "total"), ["lang", "source"])
    column = F.collect_list(F.struct("source", "n", "total")).alias("column")
    joint = entries.groupBy("vector").agg(F.first("lang").alias("lang"), column, F.first("many").alias("many")).select("lang", "column", "many")
    joint = joint.mapInArrow(_joint, "lang string, source string, item string, value long")

    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other"), F.col("n_terms").alias("other_terms"))
    pairs = groups.join(other, "lang").where("source <> item")
    zero = lambda c: _share(F.lit(0), F.col(c))
    neither = F.when(F.col("n_kept") > 0, (F.col("n_kept") - F.col("n_terms") - F.col("other_terms")) * _value(zero("total"), zero("other"))).otherwise(0)
    base = pairs.select("lang", "source", "item", neither.cast("long").alias("value"))

    alike = terms.select("lang", F.inline("column")).groupBy("lang", "source", "n").agg(F.count("*").alias("many"))  # all terms that a source has so often
    alone = alike.join(pairs.select("lang", "source", "item", "total", "other"), ["lang", "source"])
    share = _share(F.col("n"), F.col("total"))
    here = alone.select("lang", "source", "item", (F.col("many") * _value(share, zero("other"))).alias("value"))
    there = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("many") * _value(zero("other"), share)).alias("value"))
    parts = base.unionByName(joint).unionByName(here).unionByName(there)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergences(docs: DataFrame, least_docs: int = 3, top: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` for every other source of the language, ``term`` for the ``top`` terms.

    Ranks go from 1 in each group and part, by descending value, then by the bytes of the item.
    """
    scratch = scratch or Scratch(docs.sparkSession, "divergence")
    terms, groups = _kept_terms(docs, least_docs, scratch)
    entries = terms.select("lang", "term", "n_lang", F.inline("column")).join(groups.select("lang", "source", "total", "total_lang"), ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total")), _share(F.col("n_lang"), F.col("total_lang"))
    more = entries.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    best = more.select("lang", "source", "item", _value(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # tasks leave out what cannot be among the top before they hand on their rows
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    pairs = _pairs(terms, groups, scratch).withColumn("rank", rank)
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return pairs.select(*columns("pair")).unionByName(best.select(*columns("term")))

"""A corpus from raw documents to token ids, in five stages.

Each stage takes all that its predecessor kept and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.bitmaps import split
from seqloom.llm.bpe import digests
from seqloom.llm.decontaminate import contaminated
from seqloom.llm.language_id import in_a_language
from seqloom.llm.line_dedup import remove_repeated_lines
from seqloom.llm.minhash_dedup import near_duplicates
from seqloom.llm.scratch import Scratch, quoted


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that none clashes with what an operator adds."""
    rest = [quoted(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.col("doc_id").alias("doc_id")).alias("rest"))


def _unpacked(packed: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns as they were, but for those in ``new``."""
    here = {c: F.col(c) for c in ("doc_id", "text")} | new
    return packed.select(*(here.get(c, F.col("rest")[c]).alias(c) for c in columns))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``gone`` (doc_id, written); only those that may be there are shuffled."""
    maybe, others = split(docs, F.xxhash64(F.col("doc_id").cast("long")), gone.select(F.xxhash64("doc_id").alias("hash")), "hash")
    gone = gone.withColumnRenamed("doc_id", "gone")
    return others.unionAll(maybe.join(gone, maybe["doc_id"] == gone["gone"], "left_anti"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: null text, text without a letter, text unlike all languages of the labelled rows.

    Each row is judged by itself: null ids and repeated rows are rows like others, texts of any length are read whole,
    an empty table gives an empty one.
    """
    return _unpacked(in_a_language(_packed(docs).withColumn("lang", F.col("rest")["lang"])), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, and with them the documents that consist of nothing else.

    n_chars follows the text.  Null ids are left alone; repeated rows are one document and all stay; null and empty
    texts stay as they are, for what removed nothing drops nothing.
    """
    cleaned = remove_repeated_lines(_packed(docs))
    left = (F.col("n_removed_lines") == 0) | (F.trim("text") != "")
    return _unpacked(cleaned.where(left), docs.columns, n_chars=F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, five-word shingles and a similarity of 0.8, the one with the smallest id stays.

    Null, empty and blank texts and null ids are linked with nothing and stay.  Repeated rows of an id are one document:
    they stay or go together.
    """
    scratch = Scratch(spark, "near")
    return _without(docs, scratch.keep(near_duplicates(docs, scratch=scratch).where("not kept").select("doc_id").distinct(), "gone"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null ids and null, empty and blank texts are not compared and stay; of rows with equal ids all go if one does.
    """
    scratch = Scratch(spark, "benchmark")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch=scratch)
    return _without(docs, scratch.keep(found.select("doc_id").distinct(), "gone"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes decoded from them.

    Null texts are empty; null ids and repeated rows are rows like others.
    """
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the profiles nor the chunks: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

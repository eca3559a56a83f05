"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, content, n_bytes, n_tokens) keyed by two digests: one of the tokenizer (file
bytes, library and its version) and one of the normalised content.  Counting joins the documents to it, encodes one
document for each distinct content that it lacks, appends those counts and reads every answer from the cache.  A file
of another tokenizer version has another digest and never meets old counts.

Content is normalised by turning null into the empty text and nothing else: the tokenizer's own normalisation is
part of its version, and a stronger one could change counts.

Defined results: null or empty text has 0 bytes and 0 tokens.  Repeated rows each give a row and are encoded once.  Null
ids are ids like others.  An empty table gives an empty one.  Texts are whole at any length.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bitmaps import split
from .scratch import Scratch

CACHE_SCHEMA = "tokenizer string, content binary, n_bytes long, n_tokens long"
#: Texts handed to the tokenizer at a time, in bytes.
ENCODE_BYTES = 1 << 20


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, library and library version."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    h = hashlib.sha256(library.encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def load_counter(path: str):
    """A function from texts to token counts, without added special tokens."""
    if path.endswith(".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in sp.encode(texts, num_threads=1)]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = load_counter(path), set()
        for batch in batches:
            keep = [not (c in seen or seen.add(c)) for c in batch.column(0).to_pylist()]
            batch = batch if all(keep) else batch.filter(pa.array(keep))
            texts, sizes, out, lo, held = batch.column(1), pc.binary_length(batch.column(1)).to_pylist(), [], 0, 0
            for i, size in enumerate(sizes):
                held += size
                if held >= ENCODE_BYTES or i + 1 == len(sizes):
                    out += count(texts.slice(lo, i + 1 - lo).to_pylist())
                    lo, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.int64())], ["content", "n_bytes", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The cache, empty if nothing was appended yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_dir: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; counts that ``cache_dir`` lacks are made and appended.

    ``tokenizer_path`` must be readable on every executor.  Two runs that append the same content at the same time
    leave two equal rows; reading takes one of them.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    known = lambda: read_cache(spark, cache_dir).where(F.col("tokenizer") == version)

    # one row per content is kept in each task before the shuffle, and one per content after it
    scratch = Scratch(spark, "token-counts")
    content = docs.select(digest.alias("content"), "doc_id")
    missing = content.groupBy("content").agg(F.min("doc_id").alias("doc_id")).join(known().select("content"), "content", "left_anti")
    missing = scratch.keep(missing.select("content", F.col("doc_id").alias("first"), F.xxhash64("content").alias("hash")), "missing")
    if not missing.isEmpty():
        # texts that the cache knows stay where they are.  Null ids cannot be joined, and repeated ids bring several texts:
        # the digest decides.  Equal rows that are left meet in one task, which encodes the first of them
        texts = split(docs.withColumn("content", digest), F.xxhash64("content"), missing, "hash")[0]
        texts = texts.join(missing.drop("hash").hint("merge"), "content").where(F.col("first").eqNullSafe(F.col("doc_id"))).select("content", "text")
        fresh = texts.mapInArrow(_counted(tokenizer_path), "content binary, n_bytes long, n_tokens long")
        fresh.select(F.lit(version).alias("tokenizer"), "content", "n_bytes", "n_tokens").write.mode("append").parquet(cache_dir)

    counts = known().groupBy("content").agg(F.min("n_bytes").alias("n_bytes"), F.min("n_tokens").alias("n_tokens"))
    # written, so that the join has its own exchange on both sides and a content that very many share is split
    counts = scratch.keep(counts, "counts")
    return content.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

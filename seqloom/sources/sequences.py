"""FASTA and FASTQ text, and the Parquet store of sequences.

A record is (seq_ind, name, short_name, seq, qual): the 0-based number of the sequence, its trimmed name line, that line's
first word, its characters, and log10 error probabilities (null without qualities).
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import log10_to_phred, phred_to_log10
from ..staging import with_rank
from .clustered import only, write_clustered
from .splits import appended, numbered_lines

RECORD = "name string, short_name string, seq string, phred string"


def parse_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """Records of a stream of lines; ``>`` starts one without and ``@`` one with qualities."""
    line = next(lines, None)
    while line is not None:
        if not line.strip():
            line = next(lines, None)
            continue
        mark, name = line[0], line[1:].strip()
        if mark not in ">@":
            raise ValueError("Sequence record starts with neither > nor @.")
        if not name:
            raise ValueError("Sequence record without a name.")
        if mark == ">":
            parts = []
            line = next(lines, None)
            while line is not None and line[:1] not in (">", "@"):
                parts.append("".join(line.split()))
                line = next(lines, None)
            yield name, name.split()[0], "".join(parts), None
        else:
            seq, plus, qual = (next(lines, None) for _ in range(3))
            if seq is None or plus is None or qual is None or plus[:1] != "+":
                raise ValueError(f"Incomplete record {name}.")
            seq, qual = "".join(seq.split()), qual.rstrip("\r\n").strip()
            if len(seq) != len(qual):
                raise ValueError(f"Sequence and quality of {name} differ in length.")
            yield name, name.split()[0], seq, qual
            line = next(lines, None)


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p, i) for i, p in enumerate(self.paths)]

    def read(self, partition: _File) -> Iterator[tuple]:
        opened = gzip.open(partition.path, "rt") if partition.path.endswith((".gz", ".gzip")) else open(partition.path)
        with opened as f:
            for i, r in enumerate(parse_records(iter(f))):
                yield (partition.number, i, *r)


class SequenceFiles(DataSource):
    """FASTA and FASTQ files, plain or gzip by suffix, on a file system that every executor mounts; a task for each file."""

    @classmethod
    def name(cls) -> str:
        return "sequence_files"

    def schema(self) -> str:
        return f"file_number long, record_number long, {RECORD}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["paths"].split("\n"))


def _finished(df: DataFrame) -> DataFrame:
    return df.withColumn("qual", F.when(F.col("phred").isNotNull(), phred_to_log10(F.col("phred")))).drop("phred")


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of the files in the order given; seq_ind counts over all of them."""
    spark.dataSource.register(SequenceFiles)
    rows = spark.read.format("sequence_files").option("paths", "\n".join(paths)).load()
    return _finished(with_rank(rows, ["file_number", "record_number"], "seq_ind")).drop("file_number", "record_number")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTA by Spark's own text reader, with seq_ind in the order of paths, files and records.

    Large files are split and any file system is read; records are counted and stay where they are.
    """
    rows = numbered_lines(spark, [path] if isinstance(path, str) else path, "\n>", "trim(value) <> ''")
    text = F.regexp_replace("value", "^>", "")
    name = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "\r", ""))
    body = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text.substr(F.position(F.lit("\n"), text) + 1, F.length(text)), r"\s", "")).otherwise("")
    rows = rows.select(F.col("record").alias("seq_ind"), name.alias("name"), F.regexp_extract(name, r"^(\S+)", 1).alias("short_name"), body.alias("seq"))
    return rows.withColumn("qual", F.lit(None).cast("array<double>"))


def _fours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of four lines each, which follow one another without gaps, in one row."""
    rest = None
    for batch in batches:
        lines = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        n = lines.num_rows // 4 * 4
        rest = lines.slice(n).combine_chunks().to_batches()[0] if n < lines.num_rows else None
        if n:
            value, at = lines["value"].combine_chunks(), np.arange(0, n, 4)
            yield pa.RecordBatch.from_arrays([lines["record"].combine_chunks().take(pa.array(at)), *(value.take(pa.array(at + i)) for i in range(4))], ["record", "l0", "l1", "l2", "l3"])


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTQ of four lines a record by Spark's own text reader, with seq_ind in the order of paths, files and lines.

    Large files are split and any file system is read.  Lines are counted; records within a split are put together where
    they are, and only the lines of those that a split cuts are moved.  A record that is not whole is an error.
    """
    lines = numbered_lines(spark, [path] if isinstance(path, str) else path, per=4)
    whole = lines.where(~F.col("edge")).select("record", "value").mapInArrow(_fours, "record long, l0 string, l1 string, l2 string, l3 string")
    cut = lines.where("edge").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("l"))
    four = whole.unionByName(cut.select("record", *(F.get("l", F.lit(i))["value"].alias(f"l{i}") for i in range(4))))
    name = F.trim(F.regexp_replace(F.col("l0").substr(F.lit(2), F.length("l0")), "\r$", ""))
    good = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (name != "")
    seq, phred = (F.regexp_replace(c, "\r$", "") for c in ("l1", "l3"))
    good = good & (F.length(seq) == F.length(phred))
    checked = F.when(F.coalesce(good, F.lit(False)), name).otherwise(F.raise_error(F.concat(F.lit("Incomplete record "), F.coalesce("l0", F.lit("")))).cast("string"))
    rows = four.select(F.col("record").alias("seq_ind"), checked.alias("name"), seq.alias("seq"), phred.alias("phred")).withColumn("short_name", F.regexp_extract("name", r"^(\S+)", 1))
    return _finished(rows).select("seq_ind", "name", "short_name", "seq", "qual")


def record_text(name: Column, seq: Column, qual: Column) -> Column:
    fastq = F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), log10_to_phred(qual))
    return F.when(qual.isNotNull(), fastq).otherwise(F.concat(F.lit(">"), name, F.lit("\n"), seq))


def write_sequences(seqs: DataFrame, path: str) -> None:
    """FASTA or FASTQ text files whose names follow seq_ind: ranges of it, each in order."""
    n = max(1, int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = seqs.repartitionByRange(n, "seq_ind").sortWithinPartitions("seq_ind")
    rows.select(record_text(F.col("name"), F.col("seq"), F.col("qual")).alias("value")).write.text(path)


def pack(inputs: list[DataFrame], path: str) -> DataFrame:
    """Append sequence tables (with seq_ind of their own) in order into one store; returns it as read.

    Sequences whose numbers go on by one are written where they are read; others are ranked first.
    """
    columns = ["name", "short_name", "seq", "qual"]
    inputs = [df.select("seq_ind", *columns) for df in inputs]
    packed = appended(inputs, "seq_ind")
    if packed is None:
        rows = None
        for i, df in enumerate(inputs):
            part = df.select(F.lit(i).alias("_input"), F.col("seq_ind").alias("_old"), *columns)
            rows = part if rows is None else rows.unionByName(part)
        packed = with_rank(rows, ["_input", "_old"], "seq_ind").select("seq_ind", *columns)
    return write_clustered(packed, "seq_ind", path)


def subsequence(seqs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (seq_ind, start, end) with ``part``; a bad index or range is an error.

    Of a store made by ``pack`` only the files and row groups that hold wanted numbers are read.
    """
    found = wanted.join(only(seqs, wanted, "seq_ind").select("seq_ind", "seq"), "seq_ind", "left")
    ok = F.col("seq").isNotNull() & (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.length("seq"))
    part = F.when(ok, F.col("seq").substr(F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")))
    return found.select("seq_ind", "start", "end", F.coalesce(part, F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit("Bad sequence index or range."))).cast("string")).alias("part"))

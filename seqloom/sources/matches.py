"""Fixed-length binary records of matches and suffix arrays, and the text form of matches."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MATCH = ("look_for", "found_in", "found_at", "found_to")


def records(contents: DataFrame, names: tuple[str, ...], error: str) -> DataFrame:
    """Rows of big-endian 64-bit integers, with their number ``ord`` in their file; contents (content) has a file a row."""
    width = 8 * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_buffer()
                if raw.size % width:
                    raise ValueError(error)
                rows = np.frombuffer(raw, ">i8").reshape(-1, len(names))
                for lo in range(0, len(rows), 1 << 16):
                    part = rows[lo : lo + (1 << 16)].astype(np.int64)
                    cols = [pa.array(np.arange(lo, lo + len(part))), *(pa.array(np.ascontiguousarray(part[:, i])) for i in range(len(names)))]
                    yield pa.RecordBatch.from_arrays(cols, ["ord", *names])

    return contents.select("content").mapInArrow(run, ", ".join(f"{n} long" for n in ("ord", *names)))


def _decoded(names: tuple[str, ...]):
    """Columns of 64-bit integers, and ``_row``, from rows (value, _row) of one record each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">i8").reshape(-1, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(raw[:, i])) for i in range(len(names))), batch.column(1)], [*names, "_row"])

    return run


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder in the order of their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    found = sorted((x.getPath().toString(), x.getLen()) for x in found if x.isFile())
    return [x for x in found if x[0].rpartition("/")[2][0] not in "_."]


def _records(spark: SparkSession, path: str, names: tuple[str, ...], error: str) -> DataFrame:
    """Rows of records with ``ord``, their number over all files; files of any size are read in many tasks."""
    width, rows, before = 8 * len(names), None, 0
    encoder = spark._jvm.org.apache.spark.sql.Encoders.BINARY()
    for file, size in _files(spark, path):
        if size % width:
            raise ValueError(error)
        if not size:
            continue
        # Spark's reader of fixed-length records cuts a file between records
        raw = spark.sparkContext._jsc.sc().binaryRecords(file, width, spark._jsc.hadoopConfiguration())
        part = DataFrame(spark._jsparkSession.createDataset(raw, encoder).toDF(), spark).select("value", F.monotonically_increasing_id().alias("_row"))
        sizes = part.groupBy(F.shiftright("_row", 33).alias("_part")).agg(F.count("*").alias("_n"))
        first = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + before
        sizes = sizes.select("_part", first.alias("_first"))  # a row for each part of a file
        part = part.mapInArrow(_decoded(names), ", ".join(f"{n} long" for n in (*names, "_row"))).withColumn("_part", F.shiftright("_row", 33))
        number = F.col("_first") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
        part = part.join(F.broadcast(sizes), "_part").select(number.alias("ord"), *names)
        rows, before = part if rows is None else rows.unionByName(part), before + size // width
    return rows if rows is not None else spark.createDataFrame([], ", ".join(f"{n} long" for n in ("ord", *names)))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path, MATCH, "Incomplete match at end of file.")


def read_suffix_array(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path, ("seq_ind", "char_ind"), "Malformed combo file.").withColumnRenamed("ord", "rank")


class _Written(WriterCommitMessage):
    def __init__(self, part: int, path: str):
        self.part, self.path = part, path


class _RecordWriter(DataSourceArrowWriter):
    """Each task writes a file of its own; the driver names them in the order of the tasks when all are there."""

    def __init__(self, path: str, columns: int):
        self.path, self.columns, self.attempts = path, columns, f"{path}/_attempts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.attempts, exist_ok=True)
        task = TaskContext.get()
        path = f"{self.attempts}/{task.partitionId():06d}-{task.taskAttemptId()}"
        with open(path, "wb") as f:
            for batch in batches:
                f.write(np.stack([batch.column(i).to_numpy() for i in range(self.columns)], axis=1).astype(">i8").tobytes())
        return _Written(task.partitionId(), path)

    def commit(self, messages: list) -> None:
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            os.replace(m.path, f"{self.path}/part-{m.part:06d}.bin")
        shutil.rmtree(self.attempts, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.attempts, ignore_errors=True)


class RecordFiles(DataSource):
    """Files of big-endian 64-bit integers in a new folder that driver and executors mount."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        path = re.sub("^file:/*", "/", self.options["path"])
        if re.match(r"[a-z0-9]+:", path):
            raise ValueError("Record files are written to a mounted folder.")
        if os.path.exists(path) and os.listdir(path):
            raise ValueError(f"The folder {path} is not empty.")
        os.makedirs(path, exist_ok=True)
        return _RecordWriter(path, len(schema.fields))


def write_records(rows: DataFrame, order: str, names: tuple[str, ...], path: str) -> None:
    """The named columns as record files, in the order of ``order``: ranges of it, a file each."""
    spark = rows.sparkSession
    spark.dataSource.register(RecordFiles)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select(order, *(F.col(c).cast("long").alias(c) for c in names)).repartitionByRange(n, order).sortWithinPartitions(order)
    ordered.select(*names).write.format("record_files").mode("append").save(path)


def record_bytes(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows with ``record``: the named columns as big-endian 64-bit integers."""
    return rows.select("*", F.unhex(F.concat(*(F.lpad(F.hex(F.col(c)), 16, "0") for c in names))).alias("record"))


def match_bytes(matches: DataFrame) -> DataFrame:
    """The record of each match as binary, 4 big-endian integers."""
    return record_bytes(matches, MATCH)


def suffix_bytes(suffixes: DataFrame) -> DataFrame:
    """The record of each place of a suffix array as binary, 2 big-endian integers."""
    return record_bytes(suffixes, ("seq_ind", "char_ind"))


def file_contents(rows: DataFrame, order: str, rows_per_file: int = 4096) -> DataFrame:
    """(number, content): the records of ``rows`` joined in the order of a dense number, so many to a file."""
    file = F.floor(F.col(order) / rows_per_file).cast("long").alias("number")
    parts = rows.groupBy(file).agg(F.array_sort(F.collect_list(F.struct(order, "record"))).alias("r"))
    return parts.select("number", F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["record"])), "")).alias("content"))


def match_text(matches: DataFrame) -> DataFrame:
    return matches.select(F.concat_ws("\t", *MATCH).alias("value"))


def parse_match_text(lines: DataFrame) -> DataFrame:
    cells = F.split("value", "\t")
    return lines.select(*(F.get(cells, F.lit(i)).cast("long").alias(c) for i, c in enumerate(MATCH)))

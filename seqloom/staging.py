"""Tables written to the folder that driver and executors share, to cut lineage and to fix a row order."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or where that is missing and all tasks run in this process, a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return named or os.path.join(tempfile.gettempdir(), "seqloom-shared")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def by_range(df: DataFrame, keys: list[Column | str], name: str, parts: int = 1) -> DataFrame:
    """``df`` in ranges of ``keys``, ``parts`` at least, sorted and staged, with ``_part`` and ``_row``, which rise with the keys."""
    n = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return staged(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)


def with_rank(df: DataFrame, keys: list[Column | str], rank: str = "rank", parts: int = 1) -> DataFrame:
    """``df`` with the 0-based place of each row in the order of ``keys``, which must be unique for a definite result.

    Ranges of the keys, ``parts`` at least, are sorted in parallel; the only data that meet are one row count for each range.
    """
    rows = by_range(df, keys, "rank", parts)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", "_first", before.alias("_before"))  # a row for each range
    return rows.join(F.broadcast(sizes), "_part").withColumn(rank, F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_before", "_first")


def key_starts(df: DataFrame, keys: list[str], start: str = "start", weight: Column | None = None, **counts: Column) -> DataFrame:
    """The different keys with ``n``, the rows that have them, further sums, and the number of rows whose keys are smaller.
    A row counts as ``weight`` rows.

    Rows with one key meet as counts; ranges of the keys add up theirs in parallel and then a sum for each range.
    """
    rows = by_range(df.groupBy(*keys).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"), *(F.sum(c).alias(k) for k, c in counts.items())), list(keys), "starts")
    before = lambda value, window: F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("_part").agg(F.sum("n").alias("_n"))
    sizes = sizes.select("_part", before("_n", Window.orderBy("_part")).alias("_before"))  # a row for each range
    inside = rows.withColumn("_inside", before("n", Window.partitionBy("_part").orderBy("_row")))
    return inside.join(F.broadcast(sizes), "_part").withColumn(start, F.col("_before") + F.col("_inside")).drop("_part", "_row", "_before", "_inside")


def with_dense_rank(df: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Like ``with_rank``, but rows with equal keys share a number and no number is left out.

    The different keys are ranked and joined back, so rows with one key, however many, need not meet in a task.
    """
    rows = staged(df, "dense")
    ranks = staged(with_rank(rows.select(*keys).distinct(), keys, "_rank").withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)}), "ranks")
    same = [rows[k].eqNullSafe(ranks[f"_key{i}"]) for i, k in enumerate(keys)]
    return rows.join(ranks, same).withColumn(rank, F.col("_rank")).drop("_rank", *(f"_key{i}" for i in range(len(keys))))

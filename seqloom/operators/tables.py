"""Sorting and looking up rows of ragged tables by typed composite keys."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import colspec
from ..staging import with_rank


def sort_table(table: DataFrame, specs: list[str], rank: str = "rank") -> DataFrame:
    """(rank, row_ind, cells) in ascending order of the keys, ties by row_ind.  Too short a row is an error."""
    keys = colspec.keys(F.col("cells"), specs)
    # only keys and row numbers go through the sort
    rows = with_rank(table.select("row_ind", *keys), [*(f"key{i}" for i in range(len(keys))), "row_ind"], rank).select(rank, "row_ind")
    return rows.join(table.select("row_ind", "cells"), "row_ind").select(rank, "row_ind", "cells")


def look_up(probes: DataFrame, database: DataFrame, probe_specs: list[str], database_specs: list[str]) -> DataFrame:
    """(probe_ind, cells) for every pair of a probe and a database row with equal keys."""
    colspec.consistent(database_specs, probe_specs)
    left = probes.select(F.col("row_ind").alias("probe_ind"), *colspec.keys(F.col("cells"), probe_specs))
    right = database.select("cells", *colspec.keys(F.col("cells"), database_specs))
    names = [c for c in left.columns if c.startswith("key")]
    return left.join(right, names).select("probe_ind", "cells")


@dataclass(frozen=True)
class SortedTable:
    """A table kept by its keys: rows (key0, key1, .., row_ind, cells) dealt to buckets by the keys and sorted in each."""

    rows: DataFrame
    specs: tuple[str, ...]
    buckets: int


def _rows_path(path: str) -> str:
    return f"{path}/rows"


def write_sorted(table: DataFrame, specs: list[str], path: str, buckets: int | None = None) -> SortedTable:
    """Keep a table (row_ind, cells) by its keys below ``path``.  Too short a row is an error.

    The rows move once, here; a look-up moves its probes to them.  ``buckets`` should be at least the number of shuffle
    partitions that look-ups run with, which is what it is without being told.
    """
    spark = table.sparkSession
    keys = [f"key{i}" for i in range(len(specs))]
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = table.select(*colspec.keys(F.col("cells"), specs), F.col("row_ind").cast("long").alias("row_ind"), "cells")
    name = f"sorted_{uuid.uuid4().hex}"
    # one task writes one bucket, so a bucket is one file
    rows.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys, "row_ind").option("path", _rows_path(path)).saveAsTable(name)
    spark.createDataFrame([(list(specs), n, rows.schema.json())], "specs array<string>, buckets int, schema string").write.parquet(f"{path}/about")
    return SortedTable(spark.table(name), tuple(specs), n)


def open_sorted(spark: SparkSession, path: str) -> SortedTable:
    """A table that ``write_sorted`` has kept, in this or another session."""
    about = spark.read.parquet(f"{path}/about").first()
    name, keys = f"sorted_{uuid.uuid4().hex}", ", ".join(f"key{i}" for i in range(len(about.specs)))
    columns = StructType.fromJson(json.loads(about.schema)).toDDL()
    location = _rows_path(path).replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}, row_ind) INTO {about.buckets} BUCKETS LOCATION '{location}'")
    return SortedTable(spark.table(name), tuple(about.specs), about.buckets)


def look_up_sorted(probes: DataFrame, database: SortedTable, probe_specs: list[str]) -> DataFrame:
    """As ``look_up``, in a sorted table: only the probes are moved (both sides, where a key is a double)."""
    colspec.consistent(list(database.specs), probe_specs)
    left = probes.select(F.col("row_ind").alias("probe_ind"), *colspec.keys(F.col("cells"), probe_specs))
    return left.join(database.rows, [f"key{i}" for i in range(len(probe_specs))]).select("probe_ind", "cells")


def look_up_first(probes: DataFrame, database: DataFrame, probe_specs: list[str], database_specs: list[str]) -> DataFrame:
    """(probe_ind, cells) of every probe with the first equal database row, no cells if there is none."""
    colspec.consistent(database_specs, probe_specs)
    left = probes.select(F.col("row_ind").alias("probe_ind"), *colspec.keys(F.col("cells"), probe_specs))
    right = database.select("row_ind", "cells", *colspec.keys(F.col("cells"), database_specs))
    names = [c for c in left.columns if c.startswith("key")]
    first = right.groupBy(*names).agg(F.min_by("cells", "row_ind").alias("cells"))
    return left.join(first, names, "left").select("probe_ind", F.coalesce("cells", F.array().cast("array<string>")).alias("cells"))


def sort_found_rows(found: DataFrame, rank: str = "rank") -> DataFrame:
    """Rows of ``look_up`` in the order of their probes, ties by their cells."""
    return with_rank(found, ["probe_ind", "cells"], rank).select(rank, "probe_ind", "cells")


def log10_total(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """group columns and log10_sum: log10 of the sum of 10^column, scaled so that nothing overflows; NaN if empty.

    Sums are made for each whole part of the logarithm first, within the tasks, so a big group is no single task's.
    """
    whole = F.floor(column).cast("double")
    part = df.groupBy(*group, whole.alias("_whole")).agg(F.sum(F.pow(F.lit(10.0), F.col(column) - whole)).alias("_sum"))
    top = F.max("_whole").over(Window.partitionBy(*group))
    total = part.withColumn("_top", top).groupBy(*group).agg(F.max("_top").alias("_top"), F.sum(F.col("_sum") * F.pow(F.lit(10.0), F.col("_whole") - F.col("_top"))).alias("_sum"))
    return total.select(*group, F.coalesce(F.col("_top") + F.log10("_sum"), F.lit(float("nan"))).alias("log10_sum"))


def widest(table: DataFrame, specs: list[str]) -> DataFrame:
    """The longest text of each key column and the number of rows ``n``, in one row."""
    keys = colspec.keys(F.col("cells"), specs)
    longest = (F.max(F.length(F.col(f"key{i}").cast("string"))).cast("long").alias(f"width{i}") for i in range(len(keys)))
    return table.select(*keys).agg(*longest, F.count("*").alias("n"))


def distinct_best(scores: DataFrame, group: str, score: str, n: int, least: float) -> DataFrame:
    """The n highest different scores of at least ``least`` in each group, with their place."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score)))
    return scores.where(F.col(score) >= least).select(group, score).distinct().withColumn("place", place.cast("long")).where(F.col("place") <= n)

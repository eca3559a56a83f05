"""Numbers for the lines of text files, from counts of the files' splits.

Spark cuts files into splits and reads each in order.  One scan counts the lines of every split; sums over the splits before
it give the number of its first line; a second scan adds them to the lines as it reads.  Only the counts meet, and no line
moves.  Both scans must cut the files alike: the counts carry what names a split, and a line outside of them is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged

_SPLIT = ("_input", "_file", "_part", "_block", "_length")


def numbered_lines(spark: SparkSession, paths: list[str], line_sep: str = "\n", where: str | None = None, per: int = 1) -> DataFrame:
    """record, place, edge, value: lines in the order of paths, files and lines, ``per`` of them a record within a file.

    ``where`` says which lines count.  ``edge`` tells whether a line's record reaches into another split.
    """
    rows = None
    for i, path in enumerate(paths):
        part = spark.read.option("lineSep", line_sep).text(path)
        part = part if where is None else part.where(where)
        at = {"_file": F.xxhash64("_metadata.file_path"), "_part": F.spark_partition_id(), "_block": F.col("_metadata.file_block_start"), "_length": F.col("_metadata.file_block_length")}
        part = part.select(F.lit(i).alias("_input"), *(c.alias(k) for k, c in at.items()), F.monotonically_increasing_id().alias("_row"), F.col("_metadata.file_path").alias("_path"), "value")
        rows = part if rows is None else rows.unionByName(part)

    # a row for each split, some hundred millionth part of what it counts
    counts = rows.groupBy(*_SPLIT).agg(F.min("_path").alias("_path"), F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = lambda value, window: F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    file = Window.partitionBy("_input", "_file").orderBy("_block")
    counts = counts.withColumn("_line", before("_n", file)).withColumn("_last", F.row_number().over(Window.partitionBy("_input", "_file").orderBy(F.desc("_block"))) == 1)
    records = F.when(F.col("_last"), F.ceil((F.col("_line") + F.col("_n")) / per)).otherwise(0)
    counts = counts.withColumn("_records", before(records, Window.orderBy("_input", "_path", "_block")))
    counts = counts.withColumn("_records", F.min("_records").over(Window.partitionBy("_input", "_file")))
    counts = staged(counts.select(*_SPLIT, "_n", "_first", "_line", "_records"), "splits")

    rows = rows.drop("_path").join(F.broadcast(counts), list(_SPLIT), "left")
    known = F.coalesce((F.col("_row") >= F.col("_first")) & (F.col("_row") < F.col("_first") + F.col("_n")), F.lit(False))
    rows = rows.withColumn("_at", F.col("_line") + F.col("_row") - F.col("_first"))
    edge = (F.col("_at") < F.ceil(F.col("_line") / per) * per) | (F.col("_at") >= F.floor((F.col("_line") + F.col("_n")) / per) * per)
    moved = F.raise_error(F.lit("The files were cut into other splits when they were read again: fix spark.sql.files.minPartitionNum."))
    or_raise = lambda value, kind: F.when(known, value).otherwise(moved.cast(kind))
    record = or_raise(F.col("_records") + F.floor(F.col("_at") / per), "long")
    return rows.select(record.alias("record"), (F.col("_at") % per).cast("int").alias("place"), or_raise(edge, "boolean").alias("edge"), "value")


def dense_from(df: DataFrame, column: str) -> tuple[int, int] | None:
    """(first, count) if the column holds that many integers in a row, each once; else None.

    Sums of hashes tell: they agree by chance about once in 10^19 tables.
    """
    mix = lambda c: F.sum(F.xxhash64(c).cast("decimal(38,0)"))
    first, last, n, total = df.agg(F.min(column), F.max(column), F.count("*"), mix(F.col(column).cast("long"))).first()
    if n == 0:
        return 0, 0
    if first is None or last - first + 1 != n:
        return None
    return (first, n) if df.sparkSession.range(first, last + 1).agg(mix(F.col("id"))).first()[0] == total else None


def appended(inputs: list[DataFrame], number: str) -> DataFrame | None:
    """The inputs one after the other, numbered anew; None if an input's own numbers have gaps or repeats.

    The rows of an input whose numbers go on by one need only be shifted, and stay where they are.
    """
    rows, before = None, 0
    for df in inputs:
        found = dense_from(df, number)
        if found is None:
            return None
        part = df.withColumn(number, F.col(number).cast("long") + (before - found[0]))
        rows, before = part if rows is None else rows.unionByName(part), before + found[1]
    return rows

"""Headerless, ragged, tab-separated tables: a row is (row_ind, cells array<string>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import with_rank
from .clustered import only, write_clustered
from .splits import appended, numbered_lines

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}


def unescape(text: Column) -> Column:
    r"""Decode ``\n \t \r \\``; any other use of a backslash is an error."""
    # backslashes in a row pair up from the left, so what lies between the pairs has single ones only
    parts = F.split(text, r"\\\\", -1)
    bad = F.exists(parts, lambda part: part.rlike(r"\\([^ntr]|\z)"))

    def plain(part: Column) -> Column:
        for code in "ntr":
            part = F.replace(part, F.lit(f"\\{code}"), F.lit(_ESCAPES[code]))
        return part

    decoded = F.array_join(F.transform(parts, plain), "\\")
    return F.when(bad, F.raise_error(F.concat(F.lit("Bad escape sequence: "), text)).cast("string")).otherwise(decoded)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for code in "ntr":
        out = F.replace(out, F.lit(_ESCAPES[code]), F.lit(f"\\{code}"))
    return out


def parse_line(line: Column, escapes: bool = True) -> Column:
    """Cells of a line; carriage returns vanish, a blank line is one empty cell."""
    cells = F.split(F.replace(line, F.lit("\r"), F.lit("")), "\t", -1)
    return F.transform(cells, unescape) if escapes else cells


def format_line(cells: Column, escapes: bool = True) -> Column:
    return F.array_join(F.transform(cells, escape) if escapes else cells, "\t")


def read_tsv(spark: SparkSession, paths: list[str], escapes: bool = True) -> DataFrame:
    """Rows of the files in the order given, with row_ind; lines are counted and stay where they are."""
    return numbered_lines(spark, paths).select(F.col("record").alias("row_ind"), parse_line(F.col("value"), escapes).alias("cells"))


def write_tsv(table: DataFrame, path: str, escapes: bool = True) -> None:
    """Text files whose names follow row_ind: ranges of it, each in order."""
    n = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = table.repartitionByRange(n, "row_ind").sortWithinPartitions("row_ind")
    rows.select(format_line(F.col("cells"), escapes).alias("value")).write.text(path)


def pack(inputs: list[DataFrame], path: str) -> DataFrame:
    """Append tables in order into one store with a new row_ind; returns it as read.

    Rows whose numbers go on by one are written where they are read; others are ranked first.
    """
    inputs = [df.select("row_ind", "cells") for df in inputs]
    packed = appended(inputs, "row_ind")
    if packed is None:
        rows = None
        for i, df in enumerate(inputs):
            part = df.select(F.lit(i).alias("_input"), F.col("row_ind").alias("_old"), "cells")
            rows = part if rows is None else rows.unionByName(part)
        packed = with_rank(rows, ["_input", "_old"], "row_ind").select("row_ind", "cells")
    return write_clustered(packed, "row_ind", path)


def fetch(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row_ind, cells) of the rows of ``wanted`` (row_ind), a row for each; an unknown number is an error.

    Of a store made by ``pack`` only the files and row groups that hold wanted numbers are read.
    """
    found = wanted.select("row_ind").join(only(store, wanted, "row_ind").select("row_ind", "cells", F.lit(True).alias("_there")), "row_ind", "left")
    cells = F.when(F.col("_there"), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("No such row: "), F.coalesce(F.col("row_ind").cast("string"), F.lit("null")))).cast("array<string>"))
    return found.select("row_ind", cells.alias("cells"))


def from_columns(df: DataFrame, row_ind: Column, *columns: Column) -> DataFrame:
    """A ragged table of a DataFrame's columns, as text."""
    return df.select(row_ind.cast("long").alias("row_ind"), F.array(*(c.cast("string") for c in columns)).alias("cells"))


def keyed_lines(lines: DataFrame) -> DataFrame:
    """(key, line) of non-blank lines, keyed by their first word; a key that occurs twice is an error."""
    text = F.trim("value")
    rows = lines.where(text != "").select(F.regexp_extract(text, r"^(\S+)", 1).alias("key"), text.alias("line"))
    once = rows.groupBy("key").agg(F.count("*").alias("n"), F.first("line").alias("line"))
    return once.select("key", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("Duplicate key: "), F.col("key"))).cast("string")).otherwise(F.col("line")).alias("line"))


def people(lines: DataFrame) -> DataFrame:
    """The trimmed lines that are not blank."""
    return lines.select(F.trim("value").alias("name")).where("name <> ''")


def variant_ids(rows: DataFrame) -> DataFrame:
    """(protein, transcript, gene) without versions from (ord, cells); the last row of a protein wins."""
    bare = lambda i: F.regexp_replace(F.get("cells", F.lit(i)), r"\..*$", "")
    rows = rows.select("ord", bare(0).alias("protein"), bare(1).alias("transcript"), bare(2).alias("gene"))
    last = rows.groupBy("protein").agg(F.max_by(F.struct("transcript", "gene"), "ord").alias("r"))
    return last.select("protein", "r.transcript", "r.gene")

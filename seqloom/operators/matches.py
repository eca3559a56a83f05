"""Matches (look_for, found_in, found_at, found_to): order, names and surroundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.matches import MATCH
from ..staging import with_rank


def sort_found(matches: DataFrame) -> DataFrame:
    """Matches with ``match_ind``, their place in the order of all four columns; equal ones follow each other."""
    return with_rank(matches.select(*MATCH), list(MATCH), "match_ind").select("match_ind", *MATCH)


def _checked(matches: DataFrame, seqs: DataFrame, *columns: str) -> DataFrame:
    return matches.join(seqs.select(F.col("seq_ind").alias("found_in"), F.lit(True).alias("_there"), *columns), "found_in", "left")


def match_error(length: Column) -> Column:
    """What is wrong with a match in a sequence of ``length`` characters, else null."""
    return (
        F.when(F.col("_there").isNull(), "Match in a sequence that does not exist.")
        .when(F.col("found_to") < F.col("found_at"), "Match ends before it starts.")
        .when((F.col("found_at") < 0) | (F.col("found_to") > length), "Match goes beyond the end of its sequence.")
    )


def problems(matches: DataFrame, seqs: DataFrame) -> DataFrame:
    """Matches with ``error``: what is wrong with them, null if nothing is."""
    return _checked(matches, seqs, "seq").select(*matches.columns, match_error(F.length("seq")).alias("error"))


def _or_raise(error: Column, value: Column) -> Column:
    return F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(value)


def names(matches: DataFrame, seqs: DataFrame) -> DataFrame:
    """Matches with the full name of the sequence they lie in; an unknown sequence is an error."""
    error = F.when(F.col("_there").isNull(), "Match in a sequence that does not exist.")
    rows = _checked(matches, seqs, "name")
    return rows.select(*matches.columns, _or_raise(error, F.col("name")).alias("name"))


def surroundings(matches: DataFrame, seqs: DataFrame, pre: int = 5, post: int = 5) -> DataFrame:
    """Three rows for each match, (name, seq): ``match_n_pre``, ``match_n`` and ``match_n_post`` for match_ind n."""
    if pre < 0 or post < 0:
        raise ValueError("The number of characters must not be negative.")
    at, to, n = F.col("found_at").cast("int"), F.col("found_to").cast("int"), F.length("seq")
    low, high = F.greatest(at - pre, F.lit(0)), F.least(to + post, n)
    cut = lambda a, b: F.col("seq").substr(a + 1, b - a)
    label = F.concat(F.lit("match_"), F.col("match_ind").cast("string"))
    rows = _checked(matches, seqs, "seq").withColumn("seq", _or_raise(match_error(n), F.col("seq")))
    parts = F.array(
        F.struct(F.concat(label, F.lit("_pre")).alias("name"), cut(low, at).alias("seq")),
        F.struct(label.alias("name"), cut(at, to).alias("seq")),
        F.struct(F.concat(label, F.lit("_post")).alias("name"), cut(to, high).alias("seq")),
    )
    return rows.select("match_ind", F.posexplode(parts).alias("part", "r")).select("match_ind", "part", "r.name", "r.seq")

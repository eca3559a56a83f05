"""Search and lookup with a streaming probe side against static tables.

The operators are stateless for each row of the probe side, so the same DataFrame functions serve: a stream of sequences
is scanned for static patterns, a stream of probes is joined to a static table, both in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import search, tables


def find_stream(sequences: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches in a stream of (seq_ind, seq)."""
    return search.find_scan(sequences, patterns)


def write_matches(sequences: DataFrame, patterns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Matches of any number of patterns in a stream of (seq_ind, seq), searched batch by batch, as Parquet in ``path``.

    A batch has a folder of its own, ``batch=<number>``, and one that is run again replaces it.
    """

    def search_batch(batch: DataFrame, number: int) -> None:
        search.find_scan(batch, patterns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sequences.writeStream.foreachBatch(search_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def look_up_stream(probes: DataFrame, database: DataFrame, probe_specs: list[str], database_specs: list[str]) -> DataFrame:
    """(probe_ind, cells) for a stream of (row_ind, cells)."""
    return tables.look_up(probes, database, probe_specs, database_specs)


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to Parquet files, exactly once, and stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

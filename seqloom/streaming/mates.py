"""Mates of a stream of alignments: the state holds those that wait."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# microseconds, which the default format cuts off
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _pair(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(parts).sort_values(["place", "entry"], na_position="first", kind="stable")
    entries = rows["entry"].tolist()
    if state.exists:
        entries.insert(0, state.get[0])
        state.remove()
    if len(entries) % 2:
        state.update((entries.pop(),))
    yield pd.DataFrame({"name": [key[0]] * (len(entries) // 2), "first": entries[::2], "second": entries[1::2]})


def mate_pairs_stream(entries: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """(name, first, second) for a stream of alignments: what ``alignments.mate_pairs`` pairs, as soon as the mate is there.

    Entries of one name are paired two by two, first those that came with an earlier batch, then by ``order`` (an integer, null
    first).  So the pairs are the batch operator's if no batch brings a smaller ``order`` for a name than one before, and every
    pair has its number there by its place among its name's.  State is one entry, as JSON, for each name whose mate is
    still to come; it goes with the pair.  A task sorts what one batch brings for one name; the source bounds batches.
    """
    schema = entries.schema
    rows = entries.select(F.col(name).cast("string").alias("name"), F.col(order).cast("long").alias("place"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in entries.columns)), _JSON).alias("entry"))
    paired = rows.groupBy("name").applyInPandasWithState(_pair, "name string, first string, second string", "entry string", "append", GroupStateTimeout.NoTimeout)
    back = lambda c: F.from_json(c, schema, _JSON).alias(c)
    return paired.select(F.col("name").cast(schema[name].dataType).alias("name"), back("first"), back("second"))

"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps aggregate before they shuffle and join each node's neighbours with one minimum per node, so a node with very
many neighbours is split by the adaptive skew join.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v.  Each node's wanted neighbours are tied to the smallest of them (or to the node)."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) in any direction, repeats and loops allowed -> (id, component_id): the smallest id reachable.

    Nodes without an edge to another node are not returned; nulls are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.keep(e, "edges")
    before = None
    while True:
        after = scratch.keep(_star(_star(e, large=True), large=False), "edges")
        state = after.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = after
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())

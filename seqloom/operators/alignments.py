"""Operators on sequencing alignments: mates, and costs by region and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged, with_rank
from .boxes import in_boxes


def mate_pairs(entries: DataFrame, name: str = "name", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(pairs, waiting): entries of one name are paired two by two in order; the last odd one waits.

    Pairs have name, pair_ind, first and second (structs of the entries).
    """
    place = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    rows = entries.select(F.col(name).alias("name"), F.struct(F.col(order).alias("_ord"), F.struct(*entries.columns).alias("entry")).alias("e"), place.alias("_n"))
    two = rows.groupBy("name", F.floor(F.col("_n") / 2).cast("long").alias("pair_ind")).agg(F.min("e._ord").alias("_low"), F.min_by("e.entry", "e._ord").alias("first"), F.max_by("e.entry", "e._ord").alias("second"), F.count("*").alias("_k"))
    pairs = two.where("_k = 2").select("name", "pair_ind", "first", "second")
    return pairs, two.where("_k = 1").select("name", "first")


def _best(points: DataFrame, boxes: DataFrame, x: tuple[str, str, str], y: tuple[str, str, str], order: list[Column], inside: str) -> DataFrame:
    """(point_id, cost) of every point: the cost of the box of the highest order that holds it.

    Boxes go by their rank, a number, so that points are reduced by hash where their boxes are, with no sort of the pairs.
    """
    ranked = staged(with_rank(boxes, order, "_rank"), "ranked")
    rows = in_boxes(points, ranked.select("_rank", *x[1:], *y[1:]), x, y, F.col("_rank")).where(inside)
    best = rows.groupBy("_cell", "point_id").agg(F.max("_rank").alias("_rank")).groupBy("point_id").agg(F.max("_rank").alias("_rank"))
    return points.select("point_id").distinct().join(best.join(ranked.select("_rank", "cost"), "_rank").drop("_rank"), "point_id", "left")


def region_costs(points: DataFrame, regions: DataFrame) -> DataFrame:
    """points (point_id, a, b) with the cost of the region of the highest priority that holds them, null if none does.

    regions (region_id, start_a, end_a, start_b, end_b, cost): half-open, -1 is open.  The priority is that of a column
    ``priority``; without one a region with four closed bounds goes before others.  Among equals the larger region_id wins.
    """
    closed = (F.col("start_a") >= 0) & (F.col("end_a") >= 0) & (F.col("start_b") >= 0) & (F.col("end_b") >= 0)
    inside = "(start_a < 0 or a >= start_a) and (end_a < 0 or a < end_a) and (start_b < 0 or b >= start_b) and (end_b < 0 or b < end_b)"
    priority = F.col("priority") if "priority" in regions.columns else F.when(closed, 1).otherwise(0)
    return _best(points, regions.withColumn("priority", priority), ("a", "start_a", "end_a"), ("b", "start_b", "end_b"), [F.col("priority"), F.col("region_id")], inside)


def quality_costs(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (point_id, quality) with the cost of the range (low, high, cost), both ends included; ranges do not overlap.

    A range covers few different qualities, so it is turned into one row for each and joined by equality.
    """
    each = ranges.select(F.explode(F.sequence("low", "high")).alias("quality"), "cost")
    return points.join(each, "quality", "left").select("point_id", "cost")


def most_constrained(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points (point_id, q, r) with the cost of the box (ord, low_q, high_q, low_r, high_r, cost) of most closed bounds.

    -1 leaves a bound open, both ends are included, the first of equals wins.
    """
    closed = sum((F.when(F.col(c) >= 0, 1).otherwise(0) for c in ("low_q", "high_q", "low_r", "high_r")), F.lit(0))
    inside = "(low_q < 0 or q >= low_q) and (high_q < 0 or q <= high_q) and (low_r < 0 or r >= low_r) and (high_r < 0 or r <= high_r)"
    return _best(points, boxes.withColumn("closed", closed), ("q", "low_q", "high_q"), ("r", "low_r", "high_r"), [F.col("closed"), -F.col("ord")], inside)

"""Points in boxes: both are dealt to the leaves of a k-d tree, within which an equality join brings them together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: Boxes for each leaf that a tree is grown for, the fewest and most levels it may have, and sampled points and boxes for each leaf.
LEAF_BOXES, LEVELS, LEAF_SAMPLE = 32, (6, 16), 16


@dataclass
class Tree:
    """A node k has the children 2k and 2k + 1; what is smaller than its ``cut`` of its ``axis`` is below the first."""

    levels: int
    axis: np.ndarray
    cut: np.ndarray
    #: For each leaf its share of the points, and for each node its ends (low x, high x, low y, high y).
    share: np.ndarray
    ends: np.ndarray


def _cut(values: np.ndarray, low: float) -> float:
    """The middle one of the values, or of few different ones the next that leaves something on either side."""
    if not len(values):
        return np.inf
    cut = float(np.partition(values, len(values) // 2)[len(values) // 2])
    least = float(values.min())
    if cut > max(least, low):
        return cut
    above = values[values > max(least, low)]
    return float(above.min()) if len(above) else np.inf


def _below(low: np.ndarray, end: np.ndarray | float) -> np.ndarray:
    """Whether boxes start before an end of a node: by strict order in doubles, which rounding of large integers cannot turn round."""
    return (low == -np.inf) | (low < end)


def _above(high: np.ndarray, end: np.ndarray | float) -> np.ndarray:
    return (high == np.inf) | (end <= high)


def grow(points: np.ndarray, boxes: np.ndarray, levels: int) -> Tree:
    """A tree from samples: points (x, y) and boxes (low x, high x, low y, high y; infinite where open).

    A node is cut in the middle of its points and of the ends of its boxes, along the axis that leaves fewer pairs to compare,
    and not at all where more than three in four are left because its boxes lie on both sides.  A box over a whole node is
    settled there and counts in none below it.
    """
    leaves = 1 << levels
    axis, cut = np.zeros(leaves, int), np.full(leaves, np.inf)
    share, ends = np.zeros(leaves), np.full((2 * leaves, 4), np.inf)
    todo = [(1, points, boxes, (-np.inf, np.inf, -np.inf, np.inf))]
    while todo:
        node, inside, met, within = todo.pop()
        ends[node] = within
        if node >= leaves:
            share[node - leaves] = len(inside) / max(len(points), 1)
            continue
        best, least = None, 0.75 * len(inside) * len(met)
        # whether boxes go over the node's low and high ends of either axis
        past = [(_below(met[:, 2 * k], within[2 * k]), _above(met[:, 2 * k + 1], within[2 * k + 1])) for k in (0, 1)]
        for k in (0, 1):
            low, high = within[2 * k : 2 * k + 2]
            corners = met[:, 2 * k : 2 * k + 2].ravel()
            at = _cut(np.concatenate([inside[:, k], corners[(corners > low) & (corners < high)]]), low)
            if np.isfinite(at):
                across = past[1 - k][0] & past[1 - k][1]
                left, first, second = inside[:, k] < at, met[:, 2 * k] < at, met[:, 2 * k + 1] >= at
                first, second = first & ~(across & past[k][0] & _above(met[:, 2 * k + 1], at)), second & ~(across & past[k][1] & _below(met[:, 2 * k], at))
                pairs = left.sum() * first.sum() + (~left).sum() * second.sum()
                if pairs < least:
                    best, least = (k, at, left, first, second), pairs
        if best is None:  # all goes on below the first child
            while node < leaves:
                node *= 2
                ends[node] = within
            share[node - leaves] = len(inside) / max(len(points), 1)
            continue
        k, at, left, first, second = best
        axis[node], cut[node] = k, at
        below, above = list(within), list(within)
        below[2 * k + 1] = above[2 * k] = at
        todo += [(2 * node, inside[left], met[first], tuple(below)), (2 * node + 1, inside[~left], met[second], tuple(above))]
    return Tree(levels, axis, cut, share, ends)


#: Tasks that share the points of a leaf.
_MOST_TASKS = 1 << 20


def _cell_of(tree: Tree, tasks: np.ndarray) -> Callable[..., Column]:
    """The cell of points (x, y, a draw): their leaf and which of its tasks."""

    def run(x: pd.Series, y: pd.Series, draw: pd.Series) -> pd.Series:
        x, y, node = x.to_numpy(), y.to_numpy(), np.ones(len(x), np.int64)
        for _ in range(tree.levels):
            node = 2 * node + (tree.cut[node] <= np.where(tree.axis[node] == 0, x, y))
        leaf = node - (1 << tree.levels)
        return pd.Series(leaf * _MOST_TASKS + draw.to_numpy() % tasks[leaf])

    return F.pandas_udf(run, "long").asNondeterministic()  # so that no condition works it out once more


def _nodes_of(tree: Tree) -> Callable[..., Column]:
    """The leaves that boxes meet in part, and the highest nodes that lie in them, these negative; bounds are infinite where open."""

    def run(low_x: pd.Series, low_y: pd.Series, high_x: pd.Series, high_y: pd.Series) -> pd.Series:
        low, high = np.stack([low_x, low_y]), np.stack([high_x, high_y])
        box, node = np.arange(low.shape[1]), np.ones(low.shape[1], np.int64)
        boxes, nodes = [], []
        for level in range(tree.levels + 1):
            over, ends = np.ones(len(node), bool), tree.ends[node]
            for k in (0, 1):
                over &= _below(low[k, box], ends[:, 2 * k]) & _above(high[k, box], ends[:, 2 * k + 1])
            done = over if level < tree.levels else np.ones(len(node), bool)
            boxes.append(box[done])
            nodes.append(np.where(over, -node, node)[done])
            box, node = box[~done], node[~done]
            if level < tree.levels:
                axis, cut = tree.axis[node], tree.cut[node]
                first, second = low[axis, box] < cut, (high[axis, box] >= cut) & (cut < np.inf)
                box, node = np.concatenate([box[first], box[second]]), np.concatenate([2 * node[first], 2 * node[second] + 1])
        box, node = np.concatenate(boxes), np.concatenate(nodes)
        node, upto = node[np.argsort(box, kind="stable")], np.cumsum(np.bincount(box, minlength=low.shape[1]))[:-1]
        return pd.Series(np.split(node, upto)) if low.shape[1] else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<long>").asNondeterministic()


def _cells_of(tasks: np.ndarray) -> Callable[..., Column]:
    """All cells of a leaf."""
    return F.pandas_udf(lambda leaf: pd.Series([v * _MOST_TASKS + np.arange(tasks[v]) for v in leaf], dtype=object), "array<long>").asNondeterministic()


def _sample(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """About ``most`` of n rows of doubles, no more than twice as many."""
    part = rows if n <= most else rows.sample(fraction=most / n, seed=1).limit(2 * most)
    return np.column_stack([c.to_numpy() for c in part.toArrow().columns])


def tree_for(points: DataFrame, boxes: DataFrame) -> Tree:
    """points (x, y) and boxes (low x, high x, low y, high y) of doubles.

    The tree has a leaf for every ``LEAF_BOXES`` boxes, 65,536 at most; the driver gets ``LEAF_SAMPLE`` points and boxes for
    each (2 million points and boxes at most, 96 MB), and how many there are.
    """
    n, m = points.count(), boxes.count()
    levels = min(max((m // LEAF_BOXES).bit_length(), LEVELS[0]), LEVELS[1])
    some = [_sample(df, k, LEAF_SAMPLE << levels) for df, k in ((points, n), (boxes, m))]
    return grow(*(s[~np.isnan(s).any(axis=1)] for s in some), levels)


def in_boxes(points: DataFrame, boxes: DataFrame, x: tuple[str, str, str], y: tuple[str, str, str], order: Column) -> DataFrame:
    """Pairs of points and boxes in one leaf, among them for every point the box of the highest ``order`` that holds it.

    points have a ``point_id``.  x and y name a coordinate and a box's bounds of it, negative ones open; points without
    both coordinates are in no box.  A box that holds a whole leaf leaves all lower ones out of it, and large boxes go to the
    highest nodes that lie in them, of which each keeps one.  Leaves with many points are dealt to several tasks, to each of
    which their boxes go.  Pairs must still be compared: a leaf's boxes hold some of its points.  The pairs lie by the hash of a
    ``_cell``: what is grouped by it and by point is not moved.
    """
    spark = points.sparkSession
    points = points.where(F.col(x[0]).isNotNull() & F.col(y[0]).isNotNull())
    boxes = boxes.where(" and ".join(f"{c} is not null" for c in (*x[1:], *y[1:])))
    at = [F.col(c[0]).cast("double") for c in (x, y)]
    low = [F.when(F.col(c[1]) < 0, float("-inf")).otherwise(F.col(c[1]).cast("double")) for c in (x, y)]
    high = [F.when(F.col(c[2]) < 0, float("inf")).otherwise(F.col(c[2]).cast("double")) for c in (x, y)]
    tree = tree_for(points.select(at[0].alias("x"), at[1].alias("y")), boxes.select(low[0].alias("a"), high[0].alias("b"), low[1].alias("c"), high[1].alias("d")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = np.clip(np.ceil(tree.share * parts), 1, _MOST_TASKS).astype(np.int64)

    dealt = boxes.select(F.struct(*boxes.columns).alias("_box"), order.alias("_order"), _nodes_of(tree)(*low, *high).alias("_nodes"))
    dealt = staged(dealt.select("_box", "_order", F.explode("_nodes").alias("_node")), "boxes")
    # one box for a node, and so few rows for all leaves below all nodes
    best = lambda row: F.max_by(row, row["_order"]).alias("_best")
    over = dealt.where("_node < 0").groupBy((-F.col("_node")).alias("_node")).agg(best(F.struct("_order", "_box")))
    down = F.lit(tree.levels + 1) - F.length(F.bin("_node"))
    first = F.call_function("shiftleft", F.col("_node"), down)
    leaves = F.explode(F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), down) - 1))
    over = over.select(leaves.alias("_leaf"), "_best").groupBy("_leaf").agg(best(F.col("_best")))
    part = dealt.where("_node > 0").withColumnRenamed("_node", "_leaf").join(over.select("_leaf", F.col("_best._order").alias("_most")), "_leaf", "left")
    part = part.where(F.col("_most").isNull() | (F.col("_order") >= F.col("_most"))).select("_leaf", "_box")
    dealt = part.unionByName(over.select("_leaf", F.col("_best._box").alias("_box")))
    dealt = dealt.select(_cells_of(tasks)(F.col("_leaf") - (1 << tree.levels)).alias("_cells"), "_box")
    dealt = dealt.select(F.explode("_cells").alias("_cell"), "_box.*")
    placed = points.withColumn("_cell", _cell_of(tree, tasks)(*at, F.xxhash64("point_id")))
    return placed.join(dealt.hint("shuffle_hash"), "_cell")

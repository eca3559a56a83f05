"""Points in boxes against a check of every pair, and the shape of the tree that deals them out."""

import random

import numpy as np
import pytest

from seqloom.operators import alignments, boxes


def _want(points, regions):
    out = {}
    for point_id, a, b in points:
        held = [(int(min(r[1:5]) >= 0), r[0], r[5]) for r in regions if None not in (a, b) and all(lo < 0 or v >= lo for v, lo in ((a, r[1]), (b, r[3]))) and all(hi < 0 or v < hi for v, hi in ((a, r[2]), (b, r[4])))]
        out[point_id] = max(held)[2] if held else None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_regions_by_a_tree(spark, monkeypatch, seed):
    monkeypatch.setattr(boxes, "LEAF_BOXES", 2)
    rng = random.Random(seed)
    side = lambda: (lambda a: (rng.choice([-1, a, a]), rng.choice([-1, a + rng.randint(0, 12), a + rng.randint(0, 12)])))(rng.randrange(100))
    regions = [(i, *side(), *side(), i * 7) for i in range(120)]
    points = [(i, *((40, 40) if i % 3 == 0 else (rng.randrange(-2, 110), rng.randrange(110)))) for i in range(400)] + [(900, None, 3), (901, 3, None), (902, None, None)]
    p, r = spark.createDataFrame(points, "point_id long, a long, b long"), spark.createDataFrame(regions, "region_id long, start_a long, end_a long, start_b long, end_b long, cost long")
    assert {x.point_id: x.cost for x in alignments.region_costs(p, r).collect()} == _want(points, regions)
    assert {x.cost for x in alignments.region_costs(p, r.limit(0)).collect()} == {None}
    assert alignments.region_costs(p.limit(0), r).count() == 0


def test_large_numbers_are_not_rounded(spark):
    big = 1 << 60
    points = [(i, big + i, 5) for i in range(40)]
    regions = [(i, big + i, big + i + 1, 0, 9, i) for i in range(40)] + [(100, -1, -1, -1, -1, 7)]
    p, r = spark.createDataFrame(points, "point_id long, a long, b long"), spark.createDataFrame(regions, "region_id long, start_a long, end_a long, start_b long, end_b long, cost long")
    assert {x.point_id: x.cost for x in alignments.region_costs(p, r).collect()} == {i: i for i in range(40)}


def test_leaves_of_a_diagonal_are_even():
    rng = np.random.default_rng(1)
    points = np.repeat(rng.uniform(0, 1e6, 20_000)[:, None], 2, axis=1)
    low = rng.uniform(0, 1e6, 4_000)
    tree = boxes.grow(points, np.column_stack([low, low + 50, low, low + 50]), 8)
    used = tree.share[tree.share > 0]
    assert len(used) == 256 and used.max() < 2 / 256
    # lines at quantiles of each axis put all on 16 of 256 cells
    assert used.max() < (1 / 16) / 8


def test_a_leaf_loses_what_a_box_over_it_beats(spark, monkeypatch):
    monkeypatch.setattr(boxes, "LEAF_BOXES", 1)
    points = [(i, i % 50, i // 50) for i in range(2500)]
    regions = [(i, -1, -1, -1, -1, i) for i in range(200)] + [(1000, 10, 20, 10, 20, 1)]
    p, r = spark.createDataFrame(points, "point_id long, a long, b long"), spark.createDataFrame(regions, "region_id long, start_a long, end_a long, start_b long, end_b long, cost long")
    from pyspark.sql import functions as F

    pairs = boxes.in_boxes(p, r.withColumn("priority", (F.col("region_id") == 1000).cast("int")), ("a", "start_a", "end_a"), ("b", "start_b", "end_b"), F.struct("priority", "region_id"))
    assert pairs.count() <= 2 * len(points)  # of 201 boxes
    assert {x.point_id: x.cost for x in alignments.region_costs(p, r).collect()} == _want(points, regions)


def test_points_are_reduced_where_their_boxes_are_without_a_sort(spark):
    p = spark.createDataFrame([(i, i, i) for i in range(40)] + [(3, 9, 9)], "point_id long, a long, b long")
    r = spark.createDataFrame([(i, i, -1 if i % 9 == 0 else i + 3, 0, -1, i) for i in range(0, 30)], "region_id long, start_a long, end_a long, start_b long, end_b long, cost long")
    got = alignments.region_costs(p, r)
    assert "max_by(cost" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("point_id = 39").first().cost == 27 and got.count() == 40


def test_boxes_over_whole_nodes_do_not_keep_a_tree_from_growing():
    rng = np.random.default_rng(2)
    low = np.arange(4000.0)
    small, open_ = np.column_stack([low, low + 9, low, low + 9]), rng.choice(low, 400)
    boxes_ = np.concatenate([small, np.column_stack([open_, np.full(400, np.inf), open_, np.full(400, np.inf)])])
    a = rng.integers(0, 4000, 16000).astype(float)
    tree = boxes.grow(np.column_stack([a, a + rng.integers(1, 8, 16000)]), boxes_, 7)
    assert (tree.share > 0).sum() > 100 and tree.share.max() < 4 / 128

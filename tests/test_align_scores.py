"""Scores of many pairs at a time against the tables of each."""

import random

import numpy as np
import pytest

from seqloom.operators import align as al


def _score(a, b, cost, ends):
    c = al.spread(a, b, cost)
    return max(s for s, _, _, _ in al.endings(al.tables(c, ends), c, ends))


@pytest.mark.parametrize("ends", [al.GLOBAL, al.SEMI, al.LOCAL])
@pytest.mark.parametrize("cells,table", [(1, 4), (40, 1 << 22), (1 << 16, 1 << 22)])
def test_best_scores(monkeypatch, ends, cells, table):
    monkeypatch.setattr(al, "_GROUP_CELLS", cells)
    monkeypatch.setattr(al, "_TABLE_CELLS", table)
    r = random.Random(ends)
    text = lambda letters, most: "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 5, most])))
    for cost in (al.Cost(), al.Cost(2, -1, -3, -1, -0.5), al.Cost(0.3, -0.7, -0.1, -0.3, 1, {("a", "b"): 5, ("c", "c"): -2, ("x", "q"): 1})):
        a, b = [text("abcé𝄞", 30) for _ in range(40)], [text("abcq", 20) for _ in range(40)]
        assert al.best_scores(a, b, cost, ends).tolist() == [_score(x, y, cost, ends) for x, y in zip(a, b, strict=True)]


def test_many_pairs_take_few_calls(monkeypatch):
    calls = []
    monkeypatch.setattr(al, "_substitution", lambda *args, whole=al._substitution: calls.append(1) or whole(*args))
    got = al.best_scores(["kitten"] * 5000 + ["sitting"] * 5000, ["sitting"] * 10000, al.Cost(), al.GLOBAL)
    assert len(calls) == 1 and np.array_equal(got, [-3.0] * 5000 + [0.0] * 5000)


def test_null_sequences_give_no_row(spark):
    rows = [(1, "ACGT", "AGT"), (2, None, "A"), (3, "A", None), (4, "", ""), (5, "", "AG")]
    pairs = spark.createDataFrame(rows, "pair_id long, a string, b string")
    assert sorted(map(tuple, al.align(pairs, al.Cost(2, -1, -3, -1, 0)).collect())) == [(1, 2.0), (4, 0.0), (5, -5.0)]

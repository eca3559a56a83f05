"""Packed numbers and ln gamma against the standard library, and files that Spark does not decompress by name."""

import gzip
import math
import struct

import pytest
from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.sources import genomics

CODES = {"int16": "h", "int32": "i", "int64": "q", "float32": "f", "float64": "d"}


@pytest.mark.parametrize("kind", sorted(CODES))
@pytest.mark.parametrize("big", [True, False])
def test_packed(spark, kind, big):
    whole = kind.startswith("int")
    bits = int(kind[-2:])
    values = [0, 1, -1, None, (1 << bits - 1) - 1, -(1 << bits - 1)] if whole else [0.0, -0.0, 1.5, None, math.inf, -2.0**-30]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {'long' if whole else 'double'}")
    rows = df.select("i", "v", text.pack(F.col("v"), kind, big).alias("p")).select("*", text.unpack(F.col("p"), kind, big).alias("u")).orderBy("i").collect()
    code = (">" if big else "<") + CODES[kind]
    assert [r.p and bytes(r.p) for r in rows] == [None if v is None else struct.pack(code, v) for v in values]
    assert [r.u for r in rows] == values
    odd = spark.createDataFrame([(b"",), (b"123",), (None,)], "b binary").select(text.unpack(F.col("b"), kind, big).alias("u"))
    assert {r.u for r in odd.collect()} == {None}


def test_integers_keep_their_lower_bytes(spark):
    assert bytes(spark.range(65537, 65538).select(text.pack(F.col("id"), "int16").alias("p")).first().p) == b"\0\1"


def test_log_gamma(spark):
    values = [k / 7 for k in range(-200, 800)] + [1e-300, 1e-9, 1e6, 3.5e200, 171.7, -1e-9, float("inf"), float("nan"), 0.0, -3.0]
    got = [r.g for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").coalesce(1).select(text.log_gamma("v").alias("g")).collect()]
    for v, g in zip(values, got, strict=True):
        if math.isnan(v):
            assert g is None or math.isnan(g)
        elif v <= 0 and v == int(v) or math.isinf(v):
            assert g == math.inf
        else:
            assert g == pytest.approx(math.lgamma(v), rel=1e-12, abs=1e-12), v
    assert spark.createDataFrame([(None,), (1.0,)], "v double").select(text.log_gamma("v").alias("g")).where("g is null").count() == 1


def test_sam_by_suffix(spark, tmp_path):
    lines = "@HD\tVN:1.6\nr1\t99\tchr1\t7\t30\t4M\t=\t37\t39\tACGT\tIIII\n" * 5000
    for suffix in (".sam", ".sam.gz", ".sam.gzip"):
        (tmp_path / f"x{suffix}").write_bytes(lines.encode() if suffix == ".sam" else gzip.compress(lines.encode()))
    rows = [sorted(map(str, genomics.read_alignments(spark, str(tmp_path / f"x{s}")).collect())) for s in (".sam", ".sam.gz", ".sam.gzip")]
    assert len(rows[0]) == 10_000 and rows[0] == rows[1] == rows[2]


def test_long_graphs_are_read_by_runs():
    body = "&a;" + "AC GT\n" * 100_000 + "[a /]T&b;[b]"
    chars, nodes, jumps = genomics.parse_graph(body)
    assert (len(chars), nodes, jumps) == (400_001, [("a", 0), ("b", 400_001)], [(400_000, 0), (400_001, 400_001), (400_001, 400_001)])
    for bad in ("A;", "A[b", "A]", "&x[y]"):
        with pytest.raises(ValueError, match="Unbalanced"):
            genomics.parse_graph(bad)

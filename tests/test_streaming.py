import datetime
import random

import pytest

from seqloom.operators import alignments, search
from seqloom.streaming.mates import mate_pairs_stream
from seqloom.streaming.search import find_stream, look_up_stream, write_matches, write_stream


def test_streams_give_the_rows_of_the_batch_operators(spark, tmp_path):
    spark.createDataFrame([(0, "AKAK", ["x"]), (1, "KK", ["y"])], "seq_ind long, seq string, cells array<string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_ind long, seq string, cells array<string>").parquet(str(tmp_path / "in"))
    patterns = spark.createDataFrame([(0, "K")], "look_for long, pattern string")
    write_stream(find_stream(stream, patterns), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, 0, 1, 2), (0, 0, 3, 4), (0, 1, 0, 1), (0, 1, 1, 2)}
    table = spark.createDataFrame([(0, ["y", "found"])], "row_ind long, cells array<string>")
    probes = stream.selectExpr("seq_ind as row_ind", "cells")
    write_stream(look_up_stream(probes, table, ["0"], ["0"]), str(tmp_path / "out2"), str(tmp_path / "c2")).awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out2")).collect()] == [(1, ["y", "found"])]


def test_a_stream_and_more_patterns_than_an_automaton_holds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "AUTOMATON_CHARS", 2)
    for i, part in enumerate([[(0, "AKAK"), (None, "KK")], [(2, "xK")]]):
        spark.createDataFrame(part, "seq_ind long, seq string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("seq_ind long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    patterns = spark.createDataFrame([(0, "K"), (1, "AK")], "look_for long, pattern string")
    with pytest.raises(ValueError, match="automaton"):
        find_stream(stream, patterns)
    write_matches(stream, patterns, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = sorted(((r.look_for, r.found_in, r.found_at, r.found_to) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted([(0, 0, 1, 2), (0, 0, 3, 4), (1, 0, 0, 2), (1, 0, 2, 4), (0, None, 0, 1), (0, None, 1, 2), (0, 2, 1, 2)], key=str)


def test_mates_across_batches(spark, tmp_path):
    rng = random.Random(3)
    schema = "name string, ord long, flag int, place struct<ref:string,at:timestamp>, tags array<string>"
    rows = [(rng.choice(["a", "b", "c", "d e", None, '"']), i, rng.choice([None, i]), (rng.choice(["x", None]), datetime.datetime(2020, 1, 1, 0, 0, 0, i)), rng.choice([None, [], ["t", None]])) for i in range(61)]
    for i in range(0, len(rows), 7):
        spark.createDataFrame(rng.sample(rows[i : i + 7], len(rows[i : i + 7])), schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    write_stream(mate_pairs_stream(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(300)
    pairs, waiting = alignments.mate_pairs(spark.createDataFrame(rows, schema))
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted((tuple(r) for r in pairs.drop("pair_ind").collect()), key=str) and got
    state = spark.read.format("statestore").load(str(tmp_path / "c"))
    assert state.count() == waiting.count()

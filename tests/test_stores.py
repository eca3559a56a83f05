"""Numbered files, clustered and sorted stores: what moves, what is read, and what comes out."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.operators import tables
from seqloom.sources import clustered, sequences, splits
from seqloom.sources import tables as tsv


@pytest.fixture(params=[30, 1000, 1 << 27])
def cut(spark, request):
    """Files in splits of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": 10, "spark.sql.files.minPartitionNum": 1}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k in keys:
        spark.conf.unset(k)


def shuffled(spark, run):
    """Bytes of shuffles written while ``run`` runs."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    total = lambda: sum(x.shuffleWriteBytes() for x in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def words(rng):
    return "".join(rng.choice("ACGTé \t") for _ in range(rng.choice([0, 1, 9, 60])))


def test_lines_are_numbered_in_order(spark, tmp_path, cut):
    rng, want = random.Random(1), []
    for folder in ("b", "a"):  # the order of the paths, then of the files' names
        (tmp_path / folder).mkdir()
        for name in ("1.tsv", "2.tsv", "3.tsv"):
            lines = [words(rng).strip() for _ in range(rng.choice([0, 1, 40]))]
            want += lines
            (tmp_path / folder / name).write_text("".join(x + "\n" for x in lines))
    got = tsv.read_tsv(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
    assert sorted((r.row_ind, "\t".join(r.cells)) for r in got.collect()) == list(enumerate(want))


def test_fasta_in_order(spark, tmp_path, cut):
    rng, want, text = random.Random(2), [], ""
    for i in range(60):
        body = [re.sub(r"\s", "", words(rng)) for _ in range(rng.choice([0, 1, 5]))]
        text += f">name {i} x\r\n" + "".join(x + "\n" for x in body)
        want.append((i, f"name {i} x", "name", "".join(body)))
    (tmp_path / "a.fa").write_text(text)
    got = sequences.read_fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "a.fa")])
    assert sorted((r.seq_ind, r.name, r.short_name, r.seq) for r in got.collect()) == want + [(i + 60, *rest) for i, *rest in want]


def test_fastq_in_splits(spark, tmp_path, cut):
    rng, want = random.Random(3), []
    for f in range(3):
        text = ""
        for _ in range(rng.choice([1, 7, 90])):
            seq = re.sub(r"\s|é", "", words(rng))
            qual = "".join(chr(rng.randint(33, 126)) for _ in seq)  # may start with @ or +
            want.append((len(want), f"r{len(want)} of {f}", seq))
            text += f"@{want[-1][1]}\n{seq}\n+\n{qual}\n"
        (tmp_path / f"{f}.fq").write_text(text)
    assert sorted((r.seq_ind, r.name, r.seq) for r in sequences.read_fastq(spark, str(tmp_path)).collect()) == want


def test_only_counts_move(spark, tmp_path):
    rng = random.Random(4)
    text = lambda mark, end: "".join(f"{mark}{i}\n{''.join(rng.choice('ACGT') for _ in range(5000))}\n{end}" for i in range(100))
    (tmp_path / "a.fa").write_text(text(">", ""))
    (tmp_path / "a.tsv").write_text(text("", ""))
    (tmp_path / "a.fq").write_text("".join(f"@{i}\n{'A' * 4000}\n+\n{'I' * 4000}\n" for i in range(100)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        for read in (sequences.read_fasta, lambda s, p: tsv.read_tsv(s, [p])):
            path = str(tmp_path / ("a.fa" if read is sequences.read_fasta else "a.tsv"))
            rows = read(spark, path)
            assert rows.rdd.getNumPartitions() > 4
            assert shuffled(spark, lambda: rows.write.format("noop").mode("overwrite").save()) < 5_000  # noqa: B023
        path = str(tmp_path / "fa")
        assert shuffled(spark, lambda: sequences.pack([sequences.read_fasta(spark, str(tmp_path / "a.fa"))] * 2, path)) < 20_000
        assert shuffled(spark, lambda: sequences.read_fastq(spark, str(tmp_path / "a.fq")).select("seq_ind", "seq").write.format("noop").mode("overwrite").save()) < 100_000  # of 800,000: records that splits cut
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    store = spark.read.parquet(path)
    assert sorted((r.seq_ind, r.name) for r in store.select("seq_ind", "name").collect()) == [(i, str(i % 100)) for i in range(200)]


def test_other_splits_in_the_second_scan_are_an_error(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("".join(f"line {i}\n" for i in range(100)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    spark.conf.set("spark.sql.files.openCostInBytes", 10)
    try:
        rows = tsv.read_tsv(spark, [str(tmp_path)])
        spark.conf.set("spark.sql.files.maxPartitionBytes", 90)
        with pytest.raises(Exception, match="other splits"):
            rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_packing_rows_with_gaps_and_repeats(spark, tmp_path):
    table = lambda ids: spark.createDataFrame([(i, [str(i)]) for i in ids], "row_ind long, cells array<string>").repartition(2)
    assert splits.dense_from(table([3, 1, 2]), "row_ind") == (1, 3) and splits.dense_from(table([]), "row_ind") == (0, 0)
    assert splits.dense_from(table([1, 1, 3]), "row_ind") is None and splits.dense_from(table([0, 4, 5, 3, 3, 0, 6]), "row_ind") is None
    for k, inputs in enumerate(([[5, 6, 7], [], [0, 1]], [[5, 9, 7], [2, 2]])):
        store = tsv.pack([table(x) for x in inputs], str(tmp_path / str(k)))
        assert sorted((r.row_ind, r.cells[0]) for r in store.collect()) == list(enumerate(str(i) for x in inputs for i in sorted(x)))


def scanned(df):
    """Rows that the scan of the widest table handed on."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_fetching_rows_reads_a_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clustered, "ROW_GROUP_BYTES", 1 << 16)
    rows = spark.range(200_000).select(F.col("id").alias("row_ind"), F.array(F.sha2(F.col("id").cast("string"), 256)).alias("cells"))
    store = tsv.pack([rows], str(tmp_path / "t"))
    ids = [7, 8, 50_000, 50_001, 120_000, 199_999, 3, 8, 90_000, 90_500, 10, 11]
    wanted = spark.createDataFrame([(i,) for i in ids], "row_ind long")
    got = tsv.fetch(store, wanted)
    assert sorted(r.row_ind for r in got.collect()) == sorted(ids) and all(len(r.cells[0]) == 64 for r in got.collect())
    assert scanned(got) < 20_000
    for bad in (200_000, -1, None):
        with pytest.raises(Exception, match="No such row"):
            tsv.fetch(store, wanted.unionAll(spark.createDataFrame([(bad,)], "row_ind long"))).collect()
    seqs = sequences.pack([rows.select(F.col("row_ind").alias("seq_ind"), F.lit("n").alias("name"), F.lit("n").alias("short_name"), F.col("cells")[0].alias("seq"), F.lit(None).cast("array<double>").alias("qual"))], str(tmp_path / "s"))
    part = sequences.subsequence(seqs, wanted.selectExpr("row_ind seq_ind", "2L start", "5L end"))
    assert {len(r.part) for r in part.collect()} == {3} and scanned(part) < 20_000
    monkeypatch.setattr(clustered, "MOST_WANTED", 3)
    assert sorted(r.row_ind for r in tsv.fetch(store, wanted).collect()) == sorted(ids)


def test_ranges(monkeypatch):
    monkeypatch.setattr(clustered, "MOST_RANGES", 3)
    assert clustered._ranges([1, 2, 3, 9, 20, 21, 90]) == [(1, 9), (20, 21), (90, 90)] and clustered._ranges([]) == [] and clustered._ranges([4, 5]) == [(4, 5)]


def test_escapes_in_long_cells(spark):
    from seqloom.sources.tables import escape, unescape

    cells = ["x\\\t\n\r\\\\n" * 20_000, "\\", "\\\\", "\\n", "", "é" * 100_000]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert sorted(r.c for r in df.select(unescape(escape(F.col("c"))).alias("c")).collect()) == sorted(cells)
    one = lambda text: spark.createDataFrame([(text,)], "c string").select(unescape(F.col("c")).alias("c")).first().c
    for bad in ("\\x", "a\\", "\\\\\\", "\\\\\\x", "y" * 100_000 + "\\q"):
        with pytest.raises(Exception, match="Bad escape"):
            one(bad)


@pytest.mark.parametrize("reopened", [False, True])
def test_look_ups_move_only_the_probes(spark, tmp_path, reopened):
    rng = random.Random(7)
    database = [(i, [str(rng.randrange(30)), rng.choice(["x", "y", ""]), f"row {i}"]) for i in range(300)]
    probes = [(i, [rng.choice(["x", "y", "zz"]), f" {rng.randrange(40)}z"]) for i in range(200)]
    make = lambda rows: spark.createDataFrame(rows, "row_ind long, cells array<string>").repartition(3)
    store = tables.write_sorted(make(database), ["i0", "1"], str(tmp_path / "it's"))
    store = tables.open_sorted(spark, str(tmp_path / "it's")) if reopened else store
    want = sorted((p, b) for p, a in probes for _, b in database if int(a[1][1:-1]) == int(b[0]) and a[0] == b[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = tables.look_up_sorted(make(probes), store, ["i1", "0"])
        assert sorted((r.probe_ind, r.cells) for r in found.collect()) == want and len(want) > 100
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert len(list((tmp_path / "it's" / "rows").glob("part-*"))) <= store.buckets
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for bad in (["i1"], ["1", "0"]):
        with pytest.raises(ValueError):
            tables.look_up_sorted(make(probes), store, bad)
    with pytest.raises(Exception, match="too few columns"):
        tables.write_sorted(make([(0, ["1"])]), ["1"], str(tmp_path / "short"))
    floats = tables.write_sorted(make([(0, ["0"]), (1, ["-0.0"]), (2, ["1.5x"])]), ["f0"], str(tmp_path / "f"))
    assert sorted((r.probe_ind, r.cells[0]) for r in tables.look_up_sorted(make([(7, ["0"]), (8, ["1.50"])]), floats, ["f0"]).collect()) == [(7, "-0.0"), (7, "0"), (8, "1.5x")]

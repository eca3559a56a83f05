"""The pipeline and the registered queries."""

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from seqloom.llm import queries
from seqloom.llm.scratch import Scratch

from .test_dedup import brute_runs, roots, shingles, words

DIR = "/root/testdata/sf0.001"


def rows(table):
    columns = sorted(table.column_names)
    return sorted(map(repr, table.select(columns).to_pandas().itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DIR).toArrow()
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        assert rows(got) == rows(con.sql(queries.ORACLES[name]).to_arrow_table())
    else:
        assert got.num_rows == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_stages(spark):
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, "12"), (-3, "")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars")
    docs = docs.unionByName(odd)
    before = {r.doc_id: r.text for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = scratch.keep(stage(spark, docs, "/root/testdata/sf0.01"), name)
        if name != "byte_bpe":
            assert docs.columns == columns
            out[name] = {r.doc_id: r.text for r in docs.collect()}
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert set(out["language_id"]) == {i for i, t in before.items() if t and any(c.isalpha() for c in t)}
    cleaned = {i: x[0] for i, x in brute_runs(list(out["language_id"].items())).items()}
    assert out["line_dedup"] == {i: t for i, t in cleaned.items() if t.strip() or t == out["language_id"][i]}
    sets = {i: shingles(t, 5) for i, t in out["line_dedup"].items()}
    ids = sorted(sets)
    close = lambda a, b: 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and close(sets[a], sets[b])]
    assert set(out["near_dedup"]) == {i for i, r in roots(ids, links).items() if i == r}
    items = [shingles(r.text, 5) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect() if len(words(r.text)) >= 5]
    dirty = {i for i in out["near_dedup"] if any(100 * len(s & sets[i]) >= 80 * len(s) for s in items)}
    assert dirty and set(out["decontaminate"]) == set(out["near_dedup"]) - dirty
    assert {r.doc_id for r in docs.collect()} == set(out["decontaminate"])


def test_run(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got.count() > 100


def languages(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.text for r in corpus_pipeline.language_id(spark, docs, DIR).collect()}


def test_unlabelled_texts_are_kept(spark):
    texts = ["Some words.", "привет", "12 3", "", None, "x"]
    assert languages(spark, [(t, None) for t in texts]) == {"Some words.", "привет", "x"}
    # one labelled line is too little to reject anything
    assert languages(spark, [*((t, None) for t in texts), ("A b c.", "en")]) == {"Some words.", "привет", "x", "A b c."}


def test_texts_in_no_known_language_go(spark):
    clean = [(r.text, r.lang) for r in spark.read.parquet(f"{DIR}/documents.parquet").where("lang is not null and text rlike '[a-z]'").collect()]
    assert len(clean) > 100
    unlabelled = [(t, None if i % 5 == 0 else lang) for i, (t, lang) in enumerate(clean)]
    odd = [("привет мир как дела", None), ("你好世界今天天气很好", None), ("qzx xkcd vbnm wrtp qqq zzzz xkj", None)]
    assert languages(spark, unlabelled + odd) == {t for t, _ in clean}


def test_a_short_label_switches_nothing_off(spark):
    clean = [(r.text, r.lang) for r in spark.read.parquet(f"{DIR}/documents.parquet").where("lang is not null and text rlike '[a-z]'").collect()]
    odd = [("привет мир как дела", None), ("你好世界今天天气很好", None)] * 3
    short = [("ok go", "xx"), ("Γεια σου κόσμε, τι κάνεις σήμερα", "el")]
    greek = [("Γεια σου, τι κάνεις", None)]
    assert languages(spark, clean + odd + short + greek) == {t for t, _ in clean + short + greek}


def test_stages_meet_odd_rows_and_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, n_lines int, n_removed_lines int, n_removed_chunks int, rest int, `a.b` string, `c``d` int, kept string, gone string, hash long"
    rows = [(1, "one line\nand another"), (2, "one line\nand another"), (2, "one line\nand another"), (None, "one line\nand another"), (3, None), (4, ""), (None, None), (5, "long words " * 100_000), (5, "long words " * 100_000)]
    docs = spark.createDataFrame([(i, t, None, "s", None, "MINE", 0.5, 7, 8, 9, 1, "dotted", 3, "k", "g", 4) for i, t in rows], schema)
    texts = lambda df: sorted(((r.doc_id, r.text and r.text[:8]) for r in df.collect()), key=repr)
    want = {
        "language_id": [(1, "one line"), (2, "one line"), (2, "one line"), (5, "long wor"), (5, "long wor"), (None, "one line")],
        "line_dedup": [(1, "one line"), (3, None), (4, ""), (5, "long wor"), (5, "long wor"), (None, None), (None, "one line")],
        "near_dedup": [(1, "one line"), (3, None), (4, ""), (5, "long wor"), (5, "long wor"), (None, None), (None, "one line")],
        "decontaminate": texts(docs),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and texts(out) == sorted(want[name], key=repr)
        assert {(r["a.b"], r["c`d"], r.lang_pred, r.score, r.n_lines, r.n_removed_lines, r.kept, r.gone) for r in out.collect()} == {("dotted", 3, "MINE", 0.5, 7, 8, "k", "g")}
        none = stage(spark, docs.limit(0), DIR)
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.byte_bpe(spark, docs, DIR).count() == len(rows) and corpus_pipeline.byte_bpe(spark, docs.limit(0), DIR).count() == 0

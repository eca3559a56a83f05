"""WARC archives, URL rules and language profiles."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from seqloom.llm import language_id, queries, url_filter, warc
from seqloom.llm.scratch import Scratch

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a", None), (2, None, "x" * 100), (3, "u\r\nv", "x" * 100), (4, "b", FAKE * 3 + "é"), (5, "c", FAKE * 3 + "é"), (6, "d", "WARC/1.0\r\n"), (7, "e", "a"), (8, "f", "a"), (None, "g", "x" * 100),
    (9, "h", "\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.0\r\n" * 20), (2, "dup", "x" * 100), (10, "i", "y" * 400_000), (11, "", ""), (12, "z", "WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n"),
]


@pytest.mark.parametrize("per_file", [1, 3, 1000])
def test_archives(spark, per_file):
    df = spark.createDataFrame([(*p, "extra", 1) for p in PAGES], "page_id long, url string, html string, payload string, first int").coalesce(2)
    scratch = Scratch(spark, "t")
    path = scratch.new("archive")
    warc.write_archive(warc.plan_records(df, scratch), path, per_file)
    got = warc.read_archive(spark, path, scratch, with_payload=True).collect()
    assert len(got) == len(PAGES)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, h or "") for i, _, h in PAGES]
    assert sorted(((r.page_id, r.payload) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(r.payload.encode()), hashlib.sha256(r.payload.encode()).hexdigest())
        refers = 4 if r.page_id == 5 else 2 if r.page_id in (None, 3) else None
        assert (r.refers_to, r.record_type) == (refers, "response" if refers is None else "revisit")
    assert {r.url for r in got if r.page_id == 3} == {"u%0D%0Av"}


def test_archives_split_at_any_byte(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = spark.createDataFrame([p for p in PAGES if p[0] != 10], "page_id long, url string, html string").coalesce(1)
    scratch = Scratch(spark, "t")
    path = scratch.new("archive")
    warc.write_archive(warc.plan_records(df, scratch), path)
    try:
        for size in (97, 256, 1000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            found = scratch.keep(warc.candidates(spark, path, scratch), "c")
            offsets = {r.off for r in warc.reachable(found, scratch).collect()}
            assert len(offsets) == len(PAGES) - 1 and found.count() > len(offsets)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("with_payload", [True, False])
def test_archives_survive_other_splits_between_scans(spark, monkeypatch, with_payload):
    rows = [(i, f"http://x/{i}", f"{i} \r\n{FAKE}" * (1 + i % 3)) for i in range(2000)]
    scratch = Scratch(spark, "t")
    path = scratch.new("archive")
    warc.write_archive(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), scratch), path)
    scan, cores = warc._pieces, iter((4, 7, 5, 11))

    def other_cores(spark, path):
        spark.conf.set("spark.sql.files.minPartitionNum", next(cores))
        return scan(spark, path)

    monkeypatch.setattr(warc, "_pieces", other_cores)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = {r.page_id: r for r in warc.read_archive(spark, path, scratch, with_payload).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {i: r.payload_digest for i, r in got.items()} == {i: hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows}
    assert not with_payload or {i: r.payload for i, r in got.items()} == {i: h for i, _, h in rows}


def test_pieces_that_are_not_found_again_are_an_error(spark, monkeypatch):
    scratch = Scratch(spark, "t")
    path = scratch.new("archive")
    warc.write_archive(warc.plan_records(spark.createDataFrame([(1, "u", FAKE * 2)], "page_id long, url string, html string"), scratch), path)
    scan, scans = warc._pieces, []
    monkeypatch.setattr(warc, "_pieces", lambda *a: scans.append(a) or (scan(*a) if len(scans) < 2 else scan(*a).where("value not like '%Record-ID%'")))
    with pytest.raises(Exception, match="not found again"):
        warc.read_archive(spark, path, scratch)


def test_records_have_their_mandatory_fields(spark):
    scratch = Scratch(spark, "t")
    path = scratch.new("archive")
    warc.write_archive(warc.plan_records(spark.createDataFrame(PAGES, "page_id long, url string, html string"), scratch), path)
    headers = [r.header for r in warc.candidates(spark, path, scratch).join(warc.reachable(warc.candidates(spark, path, scratch), scratch), ["file", "off"]).collect()]
    assert len(headers) == len(PAGES)
    for h in headers:
        assert all(f"\r\n{name}: " in f"\r\n{h}" for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"))
        assert ("WARC-Profile: " in h) == ("WARC-Type: revisit" in h)


def test_no_pages(spark):
    df, scratch = spark.createDataFrame([], "page_id long, url string, html string"), Scratch(spark, "t")
    path = scratch.new("archive")
    warc.write_archive(warc.plan_records(df, scratch), path)
    assert warc.read_archive(spark, path, scratch).count() == 0


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/")]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.COM/en/71?x", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://example.com/en/8#y", "example.com", "/en/8", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://com/en/", "com", "/en/", "com/en/", "block"),
        ("http://xcom/en/", "xcom", "/en/", None, "allow"),
        ("http://x.net?/de/", "x.net", "", None, "allow"),
        ("http://x.net/EN/porn/a", "x.net", "/EN/porn/a", None, "block"),
        ("http://x.org/porno.html", "x.org", "/porno.html", None, "block"),
        ("http://x.org/pornography", "x.org", "/pornography", None, "allow"),
        ("http://casino.org/casino", "casino.org", "/casino", None, "allow"),
        ("http://casino.org/poker", "casino.org", "/poker", None, "block"),
        ("http://essex.org/sexton", "essex.org", "/sexton", None, "allow"),
        ("casino poker", "", "", None, "block"),
        ("http://", "", "", None, "allow"),
        ("a://b://c", "b:", "//c", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x", 9)], "page_id long, url string, host string, weight int")
    assert tuple(url_filter.judge_urls(df, RULES).first()) == (1, host, path, rule, verdict)


def test_terms_and_rules_against_sql(spark, tmp_path):
    rng = random.Random(4)
    words = [*url_filter.STRICT_TERMS, *url_filter.SOFT_TERMS, "essex", "alphabet", "analysis", "sport", "news", "en", "de", "7", "xxxl", "sexton", ""]
    hosts = ["example.com", "Example.NET", "a.b.example.com", "x.org", "com", "notexample.com", ""]
    rows = []
    for i in range(600):
        path = "".join(rng.choice("/-_.?#=&") + (rng.choice(words) if rng.random() < 0.8 else rng.choice(words) + rng.choice("a1é")) for _ in range(rng.randint(0, 4)))
        url = rng.choice(["http://", "https://", "", "HTTP://"]) + rng.choice(hosts) + rng.choice(["", "/en/", "/de/8", "/en/7", "/es/"]) + (path.upper() if rng.random() < 0.1 else path)
        rows.append((i // 2 * 2 if rng.random() < 0.1 else i, url if rng.random() < 0.98 else None, "<html>"))
    rows += [(9000, "http://x/" + "a/" * 50_000 + "porn", ""), (9001, rows[0][1], ""), (9001, rows[0][1], ""), (None, "http://x.org/hentai", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op9_url_filter(spark, str(tmp_path)).toArrow()
    verdicts = got.to_pandas().groupby(["verdict", got.to_pandas()["rule"].isna()]).size()
    assert verdicts["block", True] > 100 and verdicts["allow", True] > 100 and verdicts["block", False] > 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet' WHERE page_id IS NOT NULL")
    rows_of = lambda t: sorted(map(repr, t.select(["page_id", "host", "path", "rule", "verdict"]).to_pylist()))
    assert rows_of(got.filter(pc.is_valid(got["page_id"]))) == rows_of(con.sql(queries.ORACLES["op9_url_filter"]).to_arrow_table())
    assert [r["verdict"] for r in got.to_pylist() if r["page_id"] is None] == ["block"]


def test_rules_of_the_query(spark, tmp_path):
    urls = {
        "http://a.com/en/x": ("com/en/", "block"),
        "http://example.com/en/7x": ("example.com/en/7", "allow"),
        "http://a.net/de/porn": ("net/de/", "allow"),
        "http://www.example.net/de/9": ("net/de/", "allow"),
        "http://www.example.net/de/8/": ("example.net/de/8", "block"),
        "http://a.org/es/": ("org/es/", "block"),
    }
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op9_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == list(urls.values())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert con.sql(f"SELECT rule, verdict FROM ({queries.ORACLES['op9_url_filter']}) ORDER BY page_id").fetchall() == list(urls.values())


def test_many_rules(spark):
    rules = [("block" if i % 2 else "allow", f"h{i}.com/p{i}") for i in range(20_000)]
    df = spark.createDataFrame([(i, f"http://www.h{i}.com/p{i}/x") for i in range(0, 20_000, 997)], "page_id long, url string")
    assert all((r.rule, r.verdict) == (f"h{r.page_id}.com/p{r.page_id}", "block" if r.page_id % 2 else "allow") for r in url_filter.judge_urls(df, rules).collect())


def test_vocabulary():
    terms = url_filter.STRICT_TERMS + url_filter.SOFT_TERMS
    assert len(terms) == len(set(terms)) > 200 and all(re.fullmatch("[a-z0-9-]+", t) for t in terms)


def test_no_urls(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_counts(text):
    out = {}
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    padded = " ".join(padded.split()).join("  ") if padded.strip() else ""
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and " " not in g[1:-1]:
                out[g] = out.get(g, 0) + 1
    return out


def unpack(g):
    out = ""
    while g:
        out, g = chr(g & (1 << 21) - 1) + out, g >> 21
    return out


@pytest.mark.parametrize("texts", [["Ab, ab  c", "", "123", "Éa\n\nß", "x"], ["", "a"], ["日本 b"], [" .", "q. "]])
def test_ngram_counts(texts):
    for t, (grams, counts) in zip(texts, language_id.ngram_counts(texts), strict=True):
        assert {unpack(int(g)): int(n) for g, n in zip(grams, counts)} == brute_counts(t)


def test_top_grams():
    g, n = np.arange(9), np.array([3, 1, 3, 2, 9, 1, 1, 2, 3])
    assert language_id.top(g, n, 4).tolist() == [4, 0, 2, 8] and language_id.top(g, n, 99).tolist() == [4, 0, 2, 8, 3, 7, 1, 5, 6]


def test_profiles_and_distance(spark):
    model = language_id.RankProfiles({"x": [1, 2, 3], "y": [3, 2, 1]}, 3)
    assert model.best(np.array([1, 2, 3]), np.array([9, 8, 7])) == ("x", 1.0)
    assert model.best(np.array([1, 2, 3]), np.array([7, 8, 9]))[0] == "y"
    assert model.best(np.array([2]), np.array([1])) == ("x", 1 - 1 / 3)
    assert model.best(np.array([9]), np.array([1])) == ("x", 0.0)


def brute_languages(rows, size):
    """Profiles, distances and scores from plain dictionaries: rows (text, lang) -> (lang_pred, score) of every text."""
    order = lambda counts: sorted(counts, key=lambda g: (-counts[g], [ord(c) for c in g.rjust(3, "\0")]))[:size]
    totals = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            for g, n in brute_counts(text).items():
                totals.setdefault(lang, {}).setdefault(g, 0)
                totals[lang][g] += n
    profiles, out = {lang: order(c) for lang, c in totals.items()}, []
    for text, _ in rows:
        own = order(brute_counts(text or ""))
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        far = {lang: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        out.append((best, max(0.0, 1 - far[best] / (size * len(own)))))
    return out


@pytest.mark.parametrize("size", [300, 40])
def test_languages_against_brute_force(spark, size):
    docs = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()]
    docs += [(None, "en"), ("", None), ("12 !", "de"), ("Éa ß", None), ("日本 b", None), docs[0]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(docs)], "doc_id long, text string, lang string")
    profiles = language_id.fit_profiles(df, size, train_docs=10**9)
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.identify(df.select("doc_id", "text"), profiles, size).collect()}
    assert got == {i: (lang, round(score, 9)) for i, (lang, score) in enumerate(brute_languages(docs, size))}


def test_language_of_documents(spark):
    en, de = "the and of to in that with which from this", "der die und ein nicht mit von auch sich ist"
    rows = [(i, f"{(en if i % 2 else de)} {i}", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 !", "de"), (103, "The And", None), (None, "und", None), (104, "the " * 30_000, "zz"), (5, rows[5][1], "en")]
    df = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language_id.language_id(df.where("lang is null or lang <> 'zz'"))
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) - 1
    assert all(found[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [found[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert found[100].score == 0 and all(0 <= r.score <= 1 for r in found.values())
    import zlib

    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(60))
    assert {r.lang_pred for r in language_id.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_id(df.limit(0)).count() == 0


def test_labels_of_held_out_documents_do_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spoilt = df.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang")))
    a, b = (language_id.language_id(x).orderBy("doc_id").collect() for x in (df, spoilt))
    assert a == b
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [r for r in a if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97

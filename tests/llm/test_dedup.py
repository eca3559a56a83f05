"""Near-duplicates, line dedup, decontamination and embeddings against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, embedding_dedup, line_dedup, minhash_dedup, queries, textnum
from seqloom.llm.components import components
from seqloom.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "A", "b"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(n // 8)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i * 7 % 1000, rng.choice([" ", "\n", "\t ", " "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return [*out, (2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "one two three"), (2007, "word " * 30_000)]


@pytest.mark.parametrize(("k", "percent", "seed", "block"), [(3, 85, 1, 512), (5, 80, 2, 512), (1, 50, 3, 512), (3, 85, 4, 2), (2, 60, 5, 3)])
def test_minhash(docs, monkeypatch, k, percent, seed, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", block)
    rows = corpus(seed)
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(ids, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs(rows), k, percent).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_minhash_in_tiles(docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        w = list(base)
        w[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = minhash_dedup.near_duplicates(docs(rows), 3, 85).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 30


def test_minhash_repeated_and_missing_ids(docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = minhash_dedup.near_duplicates(docs([(5, a), (5, b), (7, b), (8, a), (9, a), (None, a), (None, None)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 5, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert minhash_dedup.near_duplicates(docs([])).count() == 0


def test_words_and_shingles():
    texts = ["a  b\tC\x0bd", None, "", "É é", "x" * 3_000_000, "p q"] + ["tail"] * 3
    column = pa.array(texts)
    data, offsets = textnum.string_buffers(column)
    h, start, end, bounds = textnum.words(data, offsets)
    spans = [bytes(data[a:b]).decode() for a, b in zip(start, end)]
    assert [spans[a:b] for a, b in zip(bounds[:-1], bounds[1:])] == [WORD.findall(t or "") for t in texts]
    for k in (1, 2, 3, 5):
        assert [len(s) for s in textnum.shingle_rows(column, k)] == [len(shingles(t, k)) for t in texts]
    sliced = column.slice(3, 4)
    assert [list(s) for s in textnum.shingle_rows(sliced, 2)] == [list(s) for s in textnum.shingle_rows(column, 2)][3:7]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(3, 3)]
    want = roots({x for e in edges for x in e}, edges)
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: r for i, r in want.items() if any(i in e and e[0] != e[1] for e in edges)}


def brute_runs(rows):
    """Texts without the lines of pairs that stood before, pair by pair and without any operator's code."""
    first, out = {}, {}
    for d, t in sorted({(d, t) for d, t in rows if d is not None and t is not None}):
        body, gone = t.removesuffix("\n").split("\n") if t else [], set()
        for i in range(len(body) - 1):
            at = first.setdefault((body[i], body[i + 1]), (d, i))
            if at[0] != d or i >= at[1] + 2:
                gone |= {i, i + 1}
        left = [x for i, x in enumerate(body) if i not in gone]
        runs = sum(i - 1 not in gone for i in gone)
        out[d] = ("\n".join(left) + ("\n" if left and t.endswith("\n") else ""), len(body), len(gone), runs)
    return out


def test_every_repeated_run_goes(docs):
    rng = random.Random(8)
    passages = [[f"p{p} line {i} é" for i in range(rng.randint(2, 5))] for p in range(12)]
    rows = []
    for i in range(300):
        body = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 1)
            body += rng.choice([p, p[a : a + 2], [f"own {i} {rng.random()}"], ["same line"], [""]])
        rows.append((i * 7 % 1000 - 300, "\n".join(body) + rng.choice(["", "\n", "\n\n"])))
    rows += [(1000, None), (1001, ""), (1002, "\n"), (1003, "\n\n\n\n"), (1004, "row\n" * 70_000), (1005, "x" * 500_000), rows[3]]
    df = docs([*rows, (None, "\n".join(passages[0]))])
    out = line_dedup.remove_repeated_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed_lines", "n_removed_chunks"]
    found = out.collect()
    assert len(found) == len(rows) + 1 and [r.text for r in found if r.doc_id is None] == ["\n".join(passages[0])]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines, r.n_removed_chunks) for r in found if r.doc_id is not None}
    assert got == brute_runs(rows) | {1000: (None, 0, 0, 0)}
    assert got[1004][0] == "row\nrow\n"
    # nothing repeated is left but what only removals brought together, and every line is still somewhere
    assert {x for _, t in rows for x in (t or "").split("\n")} == {x for t, *_ in got.values() for x in (t or "").split("\n")} | {""}
    assert line_dedup.remove_repeated_lines(docs([])).count() == 0


def test_a_short_passage_among_other_lines_goes(spark, tmp_path):
    passage = ["the first line of the passage", "its second line"]
    rows = [(i, "\n".join([*(f"before {i} {j}" for j in range(i % 5)), *passage, *(f"after {i} {j}" for j in range(i % 3))]), "en", "s", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed_lines for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: 2 if i else 0 for i in range(60)}


def test_equal_ids_with_other_texts_are_other_documents(docs):
    got = sorted(r.text for r in line_dedup.remove_repeated_lines(docs([(1, "a\nb\nc"), (1, "x\na\nb"), (1, "a\nb\nc")])).collect())
    assert got in (["a\nb\nc", "a\nb\nc", "x"], ["c", "c", "x\na\nb"])


def test_many_texts_of_one_id(docs):
    text = lambda i: f"head {i}\nown {i}\n" + (f"shared {i % 40}\nby {i % 40} some\n" if i % 3 else "") + f"tail {i}"
    rows = [(1, text(i)) for i in range(900)] + [(1, text(5)), (2, text(7)), (0, "shared 1\nby 1 some")]
    out = sorted((r.doc_id, r.text) for r in line_dedup.remove_repeated_lines(docs(rows)).collect())
    lines = [x for _, t in out for x in t.split("\n")]
    # nothing unique is lost, of every shared pair one is left, and equal rows are one document
    assert sum(x.startswith("head ") for x in lines) == 901 and {t.split("\n")[0] for i, t in out if i == 2} == {""}
    assert all(lines.count(f"by {i} some") == 1 or (i == 5 and lines.count("by 5 some") == 2) for i in range(40))
    assert [t for i, t in out if i == 0] == ["shared 1\nby 1 some"]


def test_versions_are_digests(spark):
    value = spark.range(1).select(line_dedup._version(F.lit("é text"))).first()[0]
    assert int(value) == int(hashlib.sha256("é text".encode()).hexdigest()[:30], 16)


def test_line_boundaries_resist_shifts(spark):
    lines = [f"line {i} of a long passage" for i in range(60)]
    rows = [(1, "\n".join(["new 1", "new 2", "new 3", *lines])), (2, "\n".join(lines)), (3, "\n".join(["x", *lines[20:30], "y"]))]
    found = line_dedup.repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    # what stands elsewhere without the rest is a chunk of its own; all lines of both texts go
    assert sorted((r.doc_id, r.place, r.lines) for r in found) == [(2, 0, 21), (2, 20, 10), (2, 29, 31), (3, 1, 10)]


@pytest.mark.parametrize("size", [2, 4, 8, 20, 40])
def test_recall_of_passages_at_any_place(docs, size):
    rng = random.Random(size)
    passages = [[f"passage {p} line {i}" for i in range(size)] for p in range(30)]
    rows = []
    for i in range(240):
        own = lambda k: [f"{i} {k} {j} own" for j in range(rng.randint(1, 8))]  # noqa: E731, B023
        rows.append((i, "\n".join([*own("a"), *rng.choice(passages), *own("b")])))
    want, got = brute_runs(rows), {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs(rows)).collect()}
    assert got == {i: x[0] for i, x in want.items()} and sum(x[2] for x in want.values()) == size * (240 - len({t.split("passage ")[1].split()[0] for _, t in rows}))


def test_odd_column_names_survive(docs):
    df = docs([(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd")]).withColumnRenamed("value", "place").withColumnRenamed("source", "a.b c,d").withColumnRenamed("rep", "_drop").withColumnRenamed("row", "cleaned")
    out = line_dedup.remove_repeated_lines(df)
    assert out.columns[: len(df.columns)] == df.columns and {r["a.b c,d"] for r in out.collect()} == {"s"}


def test_exact_copies_leave_one(docs):
    text = "a b\nc d\ne f\ng h\ni j"
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs([(3, text), (1, text), (2, text), (1, text)])).collect()}
    assert got == {1: text, 2: "", 3: ""}


def test_decontamination(spark, docs):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([5, 9, 20, 50, 130, 600])))) for i in range(40)] + [(50, "lone"), (51, "Two words"), (52, "one two three four"), (53, None), (54, ""), (None, "v1 v2 v3 v4 v5"), (55, "Two words")]
    rows = []
    for i in range(150):
        w = make(rng.choice([3, 60, 3000]))
        if i % 2:
            w[rng.randrange(len(w)) : 0] = []
            item = words(rng.choice(items[:40])[1])
            for _ in range(rng.choice([0, 0, 1, 3])):
                item[rng.randrange(len(item))] = "edited"
            at = rng.randrange(len(w))
            w[at:at] = item
        if i % 10 == 0:
            w[1:1] = ["TWO", "words"]
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "lone"), (903, "one two three four"), (904, items[0][1]), (904, items[0][1]), (None, items[0][1]), (905, items[1][1] + " " + "z " * 40_000 + items[2][1])]
    want = set()
    for d, t in rows:
        if d is None:
            continue
        have, w = shingles(t, 5) if len(words(t)) >= 5 else set(), words(t)
        for i, x in items:
            iw = words(x)
            if i is None or not iw:
                continue
            if len(iw) < 5:
                if any(w[j : j + len(iw)] == iw for j in range(len(w) - len(iw) + 1)):
                    want.add((d, i, 1, 1))
            else:
                s = shingles(x, 5)
                if 100 * len(s & have) >= 80 * len(s):
                    want.add((d, i, len(s), len(s & have)))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontaminate.contaminated(docs(rows), table).collect()} == want and len(want) > 60
    assert decontaminate.contaminated(docs([]), table).count() == 0
    assert decontaminate.contaminated(docs(rows), table.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] * rng.uniform(0.5, 2) + 0.05 * rng.normal(size=16) * (i % 4)).tolist()) for i in range(300)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, []), (1004, [0.0] * 16), (1005, [float("nan")] * 16), (1006, [1.0, None] * 8), (1007, [1e200] * 16), (1008, [1e-200] * 16), (1009, [1.0, 2.0]), (1010, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, label int, raw int").repartition(5)
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want = roots([i for i, _ in rows if i is not None], links)
    n = {i: sum(i in e for e in links) for i in want}
    got = embedding_dedup.near_duplicate_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {i: (n[i], want[i], want[i] == i) for i in want}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(1)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.95, 0.96, size=(1500, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack([a, c * a + np.sqrt(1 - c * c) * z]))], "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicate_vectors(df).selectExpr("sum(n_links)").first()[0]
    assert found / 3000 >= 0.97


def test_embeddings_of_many_lengths_need_few_pivots(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "MOST_LENGTHS", 2)
    rng = np.random.default_rng(4)
    rows = []
    for size in (3, 5, 6, 9):  # two have pivots, one is a list in tiles, one fits in a block
        base = rng.normal(size=(20 if size < 9 else 3, size))
        rows += [(len(rows) + i, (v + 0.01 * rng.normal(size=size)).tolist()) for i, v in enumerate(np.repeat(base, 2, axis=0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    classes = embedding_dedup.usable(df, "vec_id", "embedding").select("raw")
    pivots = embedding_dedup.choose_pivots(classes, 64)
    assert len(pivots) == 2 and sum(len(x) for x in pivots.values()) <= 64
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    missed = sum(sum(i in e for e in links) - got[i] for i in unit)
    assert missed <= 0.02 * 2 * len(links) and len(links) >= 60

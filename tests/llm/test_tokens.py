"""Token counts, token files and byte-level BPE against the libraries, on odd texts."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from seqloom.llm import bpe, token_counts, token_files
from seqloom.llm.scratch import Scratch

RANKS, WORDS, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n \n", "a", "A.", "don't I'LL <|endoftext|> <|EndOfText|>", "Straße, É.É J\u030c H\u0331 \u0130 Σς", "日本語 、 ﬁ Å", "x" * 5000, "ab" * 999 + " " + "=-" * 400, "word, word. word!? 12,5 a\u00a0b\x85c\x1cd", "long text " * 20_000]
ROWS = [*enumerate(ODD), (3, "\n\n \n"), (100, "a"), (None, "no id"), (-5, "A.")]


def test_rank_queue_against_the_library():
    ranks = bpe.read_ranks(RANKS)
    enc, own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.ByteBpe(ranks)
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab ethn=\n0é'") for _ in range(rng.randint(0, 90))) for _ in range(800)] + ["a" * n for n in (2, 3, 4, 5, 6, 7, 1001)]
    got = list(bpe.encode_texts(RANKS, P.PATTERN, texts))
    assert got == [enc.encode_ordinary(t) for t in texts]
    assert [own.decode(x).decode() for x in got] == texts


def test_long_piece_without_pattern():
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    text = "".join(random.Random(2).choice("ethnsao") for _ in range(20_000))
    assert list(bpe.ByteBpe(ranks).encode_pieces([text.encode()])[0]) == enc.encode_ordinary(text)


@pytest.mark.parametrize("merged", [False, True])
def test_rank_queue_with_other_vocabularies(merged):
    rng = random.Random(5)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        if merged:  # each token is made of two before it, in any order of ranks
            have = [b"a", b"b", b"c"]
            while len(have) < 30:
                have.append(rng.choice(have) + rng.choice(have))
            more = list(dict.fromkeys(x for x in have if 1 < len(x) < 9))
        else:
            more = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)})
            rng.shuffle(more)
        ranks = {t: i for i, t in enumerate(rng.sample(tokens, 256) + more if merged or rng.random() < 0.5 else more + tokens)}
        enc, own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}), bpe.ByteBpe(ranks)
        texts = ["".join(rng.choice("abc") for _ in range(rng.choice([3, 12, 60, 400]))) for _ in range(60)]
        assert [list(x) for x in own.encode_pieces([t.encode() for t in texts])] == [enc.encode_ordinary(t) for t in texts]


def test_bitmap_queue():
    rng, queue, have = random.Random(3), bpe.BitmapQueue(300_000), set()
    for _ in range(5000):
        i = rng.randrange(300_000)
        if rng.random() < 0.6:
            queue.add(i)
            have.add(i)
        elif have:
            i = rng.choice(sorted(have)) if rng.random() < 0.1 else i
            queue.remove(i) if i in have else None
            have.discard(i)
        assert queue.first() == min(have, default=-1)


def test_memo_forgets_what_does_not_fit():
    memo = bpe.PieceMemo(lambda xs: [x.upper() for x in xs], 2)
    for texts in (["a", "b"], ["c", "a"], ["d", "e", "b"]):
        known = memo.lookup([texts])
        assert [known[t] for t in texts] == [t.upper() for t in texts]
    memo.lookup([["a"]])
    assert set(memo.known) == {"a", "b"}


def test_bpe_rows(docs):
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in ROWS:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.digests(docs(ROWS), RANKS, P.PATTERN, with_ids=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert all(len(r.ids) == r.n_tokens for r in got)
    encoded = bpe.encode_documents(docs(ROWS), RANKS, P.PATTERN)
    back = bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in ROWS)
    assert bpe.digests(docs([]), RANKS, P.PATTERN).count() == 0


def test_counts_and_cache(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = Scratch(spark, "t").new("cache")
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in ROWS), key=str)
    first = sorted((tuple(r) for r in token_counts.token_counts(docs(ROWS), PIECES, cache).collect()), key=str)
    assert first == want
    rows = spark.read.parquet(cache)
    contents = len({t or "" for _, t in ROWS})
    assert rows.count() == contents and rows.select("content").distinct().count() == contents
    again = sorted((tuple(r) for r in token_counts.token_counts(docs([*ROWS, (9000, "new")]), PIECES, cache).collect()), key=str)
    assert len(again) == len(want) + 1 and spark.read.parquet(cache).count() == contents + 1
    token_counts.token_counts(docs(ROWS), WORDS, cache).count()  # another tokenizer version meets none of these
    assert spark.read.parquet(cache).count() == 2 * contents + 1
    assert token_counts.token_counts(docs([]), PIECES, Scratch(spark, "t").new("cache")).count() == 0


def test_stored_counts_are_used(spark, docs):
    cache = Scratch(spark, "t").new("cache")
    version = token_counts.tokenizer_version(PIECES)
    spark.createDataFrame([(version, hashlib.sha256(b"a").digest(), 1, 77)], token_counts.CACHE_SCHEMA).write.parquet(cache)
    assert token_counts.token_counts(docs([(1, "a")]), PIECES, cache).first().n_tokens == 77


def shuffled(spark, run):
    """Bytes of shuffles written while ``run`` runs."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    total = lambda: sum(x.shuffleWriteBytes() for x in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_hits_move_no_text(spark, docs):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.random()}" for _ in range(300))) for i in range(200)]
    cache = Scratch(spark, "t").new("cache")
    count = lambda rows: token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, cache).collect()
    first = shuffled(spark, lambda: count(rows))
    again = shuffled(spark, lambda: count(rows))
    more = shuffled(spark, lambda: count([*rows, (900, "one new text")]))
    assert first > 400_000 and again < 40_000 and more < 40_000


def test_part_encoder_is_the_library():
    e = token_files.PartEncoder(WORDS)
    assert e.by_part
    rng = random.Random(1)
    signs = ["a", "B", "é", "É", "J", "h", " ", " ", "\u0301", "\u030c", "\u0331", "'", "s", ".", ",", "<|endoftext|>", "<|EndOfText|>", "İ", "Σ", "ς", "1", "\n", "\t", "\u00a0", "K", "日", "ß", "ﬁ", "-", "!", "\x85"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + [t for t in ODD if t]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert list(e.encode([t.encode() for t in texts])) == want


def test_part_encoder_on_random_signs():
    e, rng = token_files.PartEncoder(WORDS), random.Random(5)
    signs = ["a", "É", "\u0130", "ß", "ﬁ", "Σ", "ς", "\u0301", "\u0338", "=", "<", "!", "'", "'s", "’", " ", "\n", "\t", "\x0b", "\r", "\x1c", "\x85", "\u00a0", "\u3000"]
    signs += ["1", "²", "<|endoftext|>", "<|EndOfText|>", "|", ".", ",", "_", "中", "\u1112", "\u1161", "\x00", "word", "The", "&&&", "\u0345"]
    for _ in range(30):
        texts = ["".join(rng.choices(signs, k=rng.choice([0, 1, 2, 3, 8, 40]))) for _ in range(100)]
        assert list(e.encode([t.encode() for t in texts])) == e._library(texts)


def test_files_round_trip(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t in order:
        x = ids(t)
        want.append((i, start, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
        start += len(x)
    path = Scratch(spark, "t").new("files")
    token_files.write_token_files(docs(ROWS), path, WORDS, end_id=2, partitions=4)
    rows = token_files.read_token_files(spark, path).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    got = token_files.with_starts(rows).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    some = token_files.read_token_files(spark, path, [5, 7]).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {i: np.array(ids(ODD[i]), "<u4").tobytes() for i in (5, 7)}
    empty = Scratch(spark, "t").new("files")
    token_files.write_token_files(docs([]), empty, WORDS)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_file_format():
    b = token_files.FileBuilder(3, 4)
    raws = [np.arange(n, dtype="<u4").tobytes() for n in (0, 5, 90_000, 1, 0, 70_000, 2)]
    for i, raw in enumerate(raws):
        b.add(i, raw)
    data = b.finish() + token_files.SEEKABLE_MAGIC
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)[: len(b"".join(raws))] == b"".join(raws)
    file = token_files.FileReader(data)
    assert (file.partition, file.number, len(file.rows)) == (3, 4, 4)
    assert [x for _, _, x in file.documents()] == raws
    opened = []
    content = file.content
    file.content = lambda f: opened.append(f) or content(f)
    assert [x for _, _, x in file.documents({5, 6})] == raws[5:] and opened == [1, 2]
    bad = bytearray(data)
    bad[30] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FileReader(bytes(bad)).documents())
    with pytest.raises(ValueError):
        token_files.FileReader(data[:-1])


def test_text_groups_keep_all_rows():
    column = pa.array(["a" * 10, None, "b" * 100, "c"])
    assert [t for g in bpe.text_groups(column, 20) for t in g] == ["a" * 10, "", "b" * 100, "c"]

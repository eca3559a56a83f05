"""Small cases worked out by hand."""

import gzip
import math
import random
import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom import bitmaps
from seqloom.functions import colspec, genome, text
from seqloom.plans import catalogue, peptides
from seqloom.operators import align, alignments, digest, graphs, matches, proteins, search, suffix, tables
from seqloom.sources import genomics, sequences
from seqloom.sources import matches as match_files
from seqloom.sources import tables as tsv
from seqloom.staging import shared_dir, staged, with_dense_rank

FOUND = {(0, 0, 4, 6), (0, 1, 0, 2), (0, 1, 2, 4), (1, 0, 1, 2), (1, 0, 5, 6), (1, 1, 1, 2), (1, 1, 3, 4), (2, 1, 0, 3), (2, 1, 2, 5)}
ARRAY = [(1, 4), (0, 3), (0, 4), (1, 2), (1, 0), (0, 5), (1, 3), (1, 1), (0, 1), (0, 0), (0, 2)]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(0, "zero a", "MKRAAK"), (1, "one b", "AKAKA")], "seq_ind long, name string, seq string")


@pytest.fixture(scope="module")
def patterns(spark):
    return spark.createDataFrame([(0, "AK"), (1, "K"), (2, "AKA"), (3, "ZZ"), (4, ""), (5, None)], "look_for long, pattern string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def fails(spark, df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def test_search_by_scan_and_by_index(spark, seqs, patterns):
    assert {tuple(r) for r in search.find_scan(seqs, patterns).collect()} == FOUND
    for head in (1, 2, 5):
        index = suffix.with_head(suffix.build(seqs), seqs, head)
        assert {tuple(r) for r in search.find(seqs, patterns, index, head).collect()} == FOUND


def test_search_in_several_passes(spark, seqs, patterns, monkeypatch):
    monkeypatch.setattr(search, "AUTOMATON_CHARS", 2)
    assert {tuple(r) for r in search.find_scan(seqs, patterns).collect()} == FOUND


@pytest.mark.parametrize(("bits", "slice_chars"), [(1 << 27, 1 << 18), (1 << 10, 50), (64, 7)])
def test_scan_and_join_give_the_same_rows(spark, monkeypatch, bits, slice_chars):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abä\U0001f600") for _ in range(rng.choice([0, 1, 7, 300]))) for _ in range(40)]
    found_in = [*enumerate(texts), (50, None), (None, "abab"), (None, texts[0]), (None, "abab"), (3, "abab"), (4, texts[4]), (4, texts[4])]
    n = 12 if bits == 64 else 120
    patterns = [(i, t[a : a + rng.choice([1, 2, 3, 5, 64, 65, 130])]) for i in range(n) for t in [rng.choice(texts)] for a in [rng.randrange(len(t) + 1)]]
    patterns += [(200, "zz" * 40), (201, ""), (202, None), (203, "ab"), (204, "ab"), (None, "b"), (203, "ab")]
    want = sorted(((k, i, a, a + len(p)) for k, p in patterns if p for i, t in found_in if t for a in range(len(t)) if t.startswith(p, a)), key=str)
    seqs, table = spark.createDataFrame(found_in, "seq_ind long, seq string"), spark.createDataFrame(patterns, "look_for long, pattern string")
    assert sorted(map(tuple, search.find_scan(seqs, table).collect()), key=str) == want and len(want) > 200
    monkeypatch.setattr(search, "AUTOMATON_CHARS", 10)
    monkeypatch.setattr(search, "SLICE_CHARS", slice_chars)
    monkeypatch.setattr(bitmaps, "MOST_BITS", bits)
    monkeypatch.setattr(search, "_scan", None)  # no automaton is built, and its patterns are not collected
    got = search.find_scan(seqs, table)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert search.find_scan(seqs.limit(0), table).count() == 0


@pytest.mark.parametrize("most", [1 << 27, 1 << 12])
def test_bitmaps_of_any_number_of_keys_stay_sparse(spark, monkeypatch, most):
    monkeypatch.setattr(bitmaps, "MOST_BITS", most)
    table = spark.range(3000).select(F.xxhash64("id").alias("h"))
    keys = np.array([r.h for r in table.collect()])
    others = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 100_000)
    of_keys, of_others, n = np.zeros(len(keys), int), np.zeros(len(others), int), 0
    for bits in bitmaps.passes(table, "h"):
        of_keys, of_others, n = of_keys + bitmaps.held(bits, keys), of_others + bitmaps.held(bits, others), n + 1
    assert n == (16 if most == 1 << 12 else 1) and (of_keys == 1).all() and of_others.mean() < 0.02


@pytest.mark.parametrize(("most", "all_move"), [(1 << 27, False), (1 << 14, False), (64, True)])
def test_split_by_bitmap(spark, monkeypatch, most, all_move):
    monkeypatch.setattr(bitmaps, "MOST_BITS", most)
    rows, table = spark.range(2000), spark.range(0, 2000, 2).select(F.xxhash64("id").alias("h"))
    maybe, others = bitmaps.split(rows, F.xxhash64("id"), table, "h")
    maybe, others = {r.id for r in maybe.collect()}, {r.id for r in others.collect()}
    assert maybe | others == set(range(2000)) and not maybe & others and set(range(0, 2000, 2)) <= maybe
    assert (len(others) == 0) if all_move else (len(others) > 950)


def test_search_null_empty_and_repeated(spark):
    seqs = spark.createDataFrame([(0, None), (1, ""), (2, "äbäb")], "seq_ind long, seq string")
    twice = spark.createDataFrame([(7, "äb"), (8, "äb")], "look_for long, pattern string")
    assert {tuple(r) for r in search.find_scan(seqs, twice).collect()} == {(k, 2, a, a + 2) for k in (7, 8) for a in (0, 2)}
    assert search.find_scan(seqs.limit(0), twice).count() == 0


@pytest.mark.parametrize("build", [suffix.build_direct, lambda s: suffix.build_doubling(s, 1)])
def test_suffix_array(spark, seqs, build):
    got = [(r.seq_ind, r.char_ind) for r in build(seqs).orderBy("rank").collect()]
    assert got == ARRAY


def test_suffix_array_of_nothing(spark, seqs):
    assert suffix.build_doubling(seqs.where("false")).count() == 0


def test_digest_rules(spark, seqs, patterns):
    found = search.find_scan(seqs, patterns)
    keep = lambda text, **kw: {tuple(r) for r in digest.filter_matches(found, seqs, digest.parse_rules(text)[0], **kw).collect()}
    assert keep("[4B52]|-[4B52]|!\n^|-[4B52]|!") == {(0, 1, 2, 4), (0, 1, 0, 2)}
    assert keep("^|-[4B52]|!") == {(0, 1, 0, 2)}
    assert keep("^|-[4B52]|!", literal=True) == {m for m in FOUND if m != (2, 1, 0, 3) and m != (2, 1, 2, 5)}
    assert keep("[4B52]|-[4B52]|$") == set()
    assert keep("") == set()


@pytest.mark.parametrize("line", ["^", "[4B", "[]|-|!", "|-|", "|-|!x", "\\", "4|-|!", "||-|!"])
def test_bad_digest_rules_are_reported(line):
    rules, bad = digest.parse_rules(line + "\n|-|!")
    assert len(rules) == 1 and len(bad) == 1


def test_surroundings_and_names(spark, seqs):
    m = spark.createDataFrame([(0, 0, 0, 4, 6)], "match_ind long, look_for long, found_in long, found_at long, found_to long")
    assert [(r.name, r.seq) for r in matches.surroundings(m, seqs).orderBy("part").collect()] == [("match_0_pre", "MKRA"), ("match_0", "AK"), ("match_0_post", "")]
    assert matches.names(m, seqs).first().name == "zero a"
    for bad, message in (((9, 0, 1), "does not exist"), ((0, 3, 2), "ends before"), ((0, 0, 99), "beyond the end"), ((0, -1, 2), "beyond the end")):
        fails(spark, matches.surroundings(m.select("match_ind", "look_for", *(F.lit(v).cast("long").alias(c) for c, v in zip(("found_in", "found_at", "found_to"), bad))), seqs), message)
    with pytest.raises(ValueError):
        matches.surroundings(m, seqs, pre=-1)


def test_tsv_cells(spark):
    parse = lambda s, e=True: one(spark, tsv.parse_line(F.lit(s), e))
    assert parse("a\tb\r") == ["a", "b"]
    assert parse("") == [""]
    assert parse(r"x\ty\\n\n") == ["x\ty\\n\n"]
    assert parse(r"x\ty", False) == [r"x\ty"]
    for bad in (r"\q", "a\\", r"\\\x"):
        fails(spark, spark.range(1).select(tsv.parse_line(F.lit(bad))), "Bad escape")
    odd = "a\\\tb\nc\\n"
    assert one(spark, tsv.parse_line(tsv.format_line(F.array(F.lit(odd), F.lit(""))))) == [odd, ""]


def test_tsv_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b"1\tx\r\n\n2\ty")
    (tmp_path / "b.tsv").write_bytes(b"3\n")
    table = tsv.read_tsv(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")])
    assert [(r.row_ind, r.cells) for r in table.orderBy("row_ind").collect()] == [(0, ["1", "x"]), (1, [""]), (2, ["2", "y"]), (3, ["3"])]
    packed = tsv.pack([table, table], str(tmp_path / "packed"))
    assert packed.count() == 8 and packed.agg(F.max("row_ind")).first()[0] == 7
    tsv.write_tsv(table, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "1\tx", "2\ty", "3"]


@pytest.mark.parametrize(("cell", "value"), [("12abc", 12), ("  -7", -7), ("x", 0), ("", 0), ("+3", 3), ("99999999999999999999", 0)])
def test_long_cells(spark, cell, value):
    assert one(spark, colspec.to_long(F.lit(cell))) == value


@pytest.mark.parametrize(("cell", "value"), [("1.5e2x", 150.0), (" -.5", -0.5), ("e5", 0.0), ("7.", 7.0)])
def test_double_cells(spark, cell, value):
    assert one(spark, colspec.to_double(F.lit(cell))) == value


@pytest.mark.parametrize(("spec", "message"), [("", "Empty"), ("i", "Malformed"), ("z1", "Unknown type"), ("ix", "Malformed"), ("-1", "Negative"), ("i-1", "Negative")])
def test_bad_column_specifications(spec, message):
    with pytest.raises(ValueError, match=message):
        colspec.parse(spec)


def test_column_specification_lists():
    assert colspec.parse_all(["0", "i3", "f2"]) == [("bytes", 0), ("long", 3), ("double", 2)]
    for args, message in ((([], []), "Must specify"), ((["0"], ["0", "1"]), "different numbers"), ((["0"], ["i0"]), "Mismatched")):
        with pytest.raises(ValueError, match=message):
            colspec.consistent(*args)


def test_sorting_and_lookups(spark):
    table = spark.createDataFrame([(0, ["b", "10"]), (1, ["a", "9"]), (2, ["a", "10"]), (3, ["a", "9"])], "row_ind long, cells array<string>")
    order = lambda *specs: [r.row_ind for r in tables.sort_table(table, list(specs)).orderBy("rank").collect()]
    assert order("0", "i1") == [1, 3, 2, 0] and order("1") == [0, 2, 1, 3] and order("f1", "0") == [1, 3, 2, 0]
    with pytest.raises(Exception, match="too few columns"):  # sorting runs at once
        tables.sort_table(table, ["5"])
    probes = spark.createDataFrame([(0, ["09"]), (1, ["nope"]), (2, ["10"])], "row_ind long, cells array<string>")
    assert sorted((r.probe_ind, r.cells[0]) for r in tables.look_up(probes, table, ["i0"], ["i1"]).collect()) == [(0, "a"), (0, "a"), (2, "a"), (2, "b")]
    first = {r.probe_ind: r.cells for r in tables.look_up_first(probes, table, ["i0"], ["i1"]).collect()}
    assert first == {0: ["a", "9"], 1: [], 2: ["b", "10"]}


def test_cigar(spark):
    got = one(spark, genome.cigar_positions(F.lit("2M1I1D3M")))
    assert (got.soft_start, got.soft_end, got.positions) == (0, 0, [0, 1, -1, 3, 4, 5])
    got = one(spark, genome.cigar_positions(F.lit("3S2M"), 7))
    assert (got.soft_start, got.soft_end, got.positions) == (3, 0, [7, 8])
    got = one(spark, genome.cigar_positions(F.lit("2H1S2=1X2N1M4S")))
    assert (got.soft_start, got.soft_end, got.positions) == (1, 4, [0, 1, 2, 5])
    for bad in ("M", "3", "-1M", "2M1S1M", "1Q"):
        assert one(spark, genome.cigar_error(F.lit(bad))), bad
        assert one(spark, genome.cigar_positions(F.lit(bad))) is None
    for good in ("", "0M", "5H3P2S4M1P2D1N3I2X1=2S1P4H", "12P", "+5M"[1:], "3M" * 20_000):
        assert one(spark, genome.cigar_error(F.lit(good))) is None, good[:30]
    runs = one(spark, genome.cigar_runs(F.lit("2H1S2=1I0M3X4D1M5S"), 7))
    assert (runs.soft_start, runs.soft_end, runs.length) == (1, 5, 7) and [tuple(r) for r in runs.runs] == [(0, 2, 7), (2, 1, -1), (3, 3, 9), (6, 1, 16)]
    long = one(spark, genome.cigar_runs(F.lit("3M1D" * 20_000)))
    assert (long.length, len(long.runs), tuple(long.runs[-1])) == (60_000, 20_000, (59_997, 3, 79_996))
    bounds = one(spark, genome.cigar_bounds(genome.cigar_runs(F.lit("3I2M5D3M"), 4)["runs"]))
    assert (bounds.first, bounds.last) == (4, 13)
    bounds = one(spark, genome.cigar_bounds(genome.cigar_runs(F.lit("3I"))["runs"]))
    assert (bounds.first, bounds.last) == (-1, -1)


def test_cigars_of_a_batch_against_a_walk(spark):
    rng = random.Random(4)
    cigars = [None, "", "7Q"] + ["".join(f"{rng.randint(0, 12)}{rng.choice('MIDN=XP')}" for _ in range(rng.choice([1, 3, 9]))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(cigars)), "i long, c string").repartition(3)
    got = {r.i: r.p for r in df.select("i", genome.cigar_positions(F.col("c"), F.col("i") * 10).alias("p")).collect()}
    for i, c in enumerate(cigars):
        if c is None or "Q" in c:
            assert got[i] is None
            continue
        ref, want, n = i * 10, [], ""
        for x in c:
            if x.isdigit():
                n += x
                continue
            want += range(ref, ref + int(n)) if x in "M=X" else [-1] * int(n) if x == "I" else []
            ref += int(n) if x in "M=XDN" else 0
            n = ""
        assert got[i].positions == want


def _location(spark, positive, cigar, locs=((100, 106), (200, 206)), at=(1, 3), chroms=("chr1",) * 9):
    ways = positive if isinstance(positive, tuple) else (positive,) * len(locs)
    l = F.array(*(F.struct(F.lit(c).alias("chrom"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(w).alias("positive")) for c, (a, b), w in zip(chroms, locs, ways))).cast("array<struct<chrom:string,start:bigint,end:bigint,positive:boolean>>")
    found = one(spark, genome.genome_location(l, F.lit(cigar).cast("string"), F.lit(at[0]), F.lit(at[1])))
    return found.location, found.warnings


def test_genome_location(spark):
    assert _location(spark, True, "4M") == ("chr1:103-105|chr1:200-202", [])
    assert _location(spark, False, "2M1I2M", at=(1, 4)) == ("chr1:202-200|-1|chr1:105-103", [])
    # residues beyond the exons are reported as such, the rest as ever
    assert _location(spark, True, "9M", at=(3, 9)) == ("chr1:203-205|-1", ["CIGAR beyond location."])
    assert _location(spark, True, "9M", at=(5, 9)) == ("-1", ["CIGAR beyond location."])
    # without a usable CIGAR residues are their own positions
    for cigar, warning in ((None, "Missing CIGAR."), ("???", "Missing CIGAR."), ("Q", "Bad CIGAR: Operation without a count in CIGAR."), ("2S18M", "Bad CIGAR: Soft clip in the CIGAR of a protein."), ("2M", "Bad CIGAR: Match beyond the end of the CIGAR.")):
        assert _location(spark, True, cigar) == ("chr1:103-105|chr1:200-202", [warning])
    # codons across exons, exons that touch, a base of its own
    assert _location(spark, True, "4M", locs=((0, 2), (2, 4), (10, 20)), at=(0, 2)) == ("chr1:0-3|chr1:10-11", ["Not whole codons."])
    assert _location(spark, True, "1M", locs=((0, 1), (5, 7)), at=(0, 1)) == ("chr1:0|chr1:5-6", [])
    assert _location(spark, False, "1M", locs=((0, 2), (5, 6)), at=(0, 1)) == ("chr1:5|chr1:1-0", [])
    # exons from the first that turns are left out
    assert _location(spark, (True, False, True), "2M", locs=((0, 6), (10, 16), (20, 26)), at=(0, 2)) == ("chr1:0-5", ["Both strands."])
    assert _location(spark, True, "4M", chroms=("chr1", "chr2"))[1] == ["Multiple chromosomes."]
    assert _location(spark, True, "4M", locs=()) == (None, ["No location."])
    # as many runs and exons as there are, in time linear in them
    assert _location(spark, True, "1M1D" * 3000, locs=((0, 18_000),), at=(0, 3000))[0].count("|") == 2999


def test_differences(spark):
    d = one(spark, genome.difference(F.lit("167-168S>F:109130043C>T")))
    assert (d.prot_start, d.prot_end, d.prot_change, d.gen_loc, d.gen_change, d.warning) == (167, 168, "S>F", 109130043, "C>T", None)
    assert one(spark, genome.difference(F.lit("abc"))).warning == "Questionable variant: abc"
    near = one(spark, genome.near_differences(genome.differences(F.lit("1-2A>B:1C>T;7-8A>B:2C>T;x")), F.lit("2M3I9M"), F.lit(2), F.lit(5), 0))
    assert [x.desc for x in near] == ["1-2A>B:1C>T"]


def test_near_differences(spark):
    near = lambda cigar, at, to, within=0: [x.desc for x in one(spark, genome.near_differences(genome.differences(F.lit("1-2A>B:1C>T;7-8A>B:2C>T;x")), F.lit(cigar).cast("string"), F.lit(at), F.lit(to), within))]
    first, second = "1-2A>B:1C>T", "7-8A>B:2C>T"
    assert near(None, 2, 5) == near("???", 2, 5) == [first] and near(None, 5, 8) == [second] and near("???", 3, 5, 2) == [first]
    assert near("9I", 2, 5, 99) == [] and near("2I9M", 0, 2) == [] and near("2I9M", 0, 2, 1) == [first] and near("9M2I", 9, 11) == [second]
    for bad, message in (("2S18M", "Soft clip"), ("3M", "beyond the end"), ("5Q", "Unknown operation")):
        with pytest.raises(Exception, match=message):
            near(bad, 2, 5)


def test_ucsc(spark):
    u = lambda t: tuple(one(spark, genome.ucsc(F.lit(t))))
    assert u("chr1:5-9") == ("chr1", 5, 9, None) and u("chr1:5") == ("chr1", 5, 6, None)
    assert u("chr1")[3] == "Malformed coordinate: chr1"


def test_rollups(spark):
    rows = spark.createDataFrame([(0, "v", "1", "5M", "d1"), (1, "v", "2", "4M", None), (2, "v", "3", "4M", "d1")], "ord long, name string, ind string, cigar string, dif string")
    v = proteins.variant_rollup(rows).first()
    assert (v.cigar, v.n_cigars, v.inds, v.difs) == ("4M", 2, ["1", "2", "3"], ["d1"])
    tie = rows.where("ord < 2")
    assert proteins.variant_rollup(tie).first().cigar == "5M"


@pytest.mark.parametrize("qual", ["".join(map(chr, range(33, 127)))])
def test_qualities_survive(spark, qual):
    assert one(spark, text.log10_to_phred(text.phred_to_log10(F.lit(qual)))) == qual


def test_text_functions(spark):
    assert one(spark, text.common_prefix(F.lit("abcd"), F.lit("abxd"))) == 2
    assert one(spark, text.common_prefix(F.lit(""), F.lit("ab"))) == 0
    assert one(spark, text.span_until(F.lit("ab]c"), "]-")) == 2
    assert one(spark, text.hex_nibble(F.lit("f"))) == 15 and one(spark, text.hex_nibble(F.lit("g"))) == -1
    assert one(spark, text.hex_byte(F.lit("4B"))) == 75 and one(spark, text.hex_byte(F.lit("4"))) == -1
    assert one(spark, text.head_hex(F.lit("AK"), 3)) == "41 4B *"


def _aligned(spark, a, b, cost, ends, most=4):
    return align.align(spark.createDataFrame([(0, a, b)], "pair_id long, a string, b string"), cost, ends, most).collect()


def test_alignment(spark):
    assert _aligned(spark, "kitten", "sitting", align.Cost(), align.GLOBAL)[0].score == -3
    best = _aligned(spark, "ACGT", "AGT", align.Cost(2, -1, -3, -1, 0), align.GLOBAL)
    assert best[0].score == 2 and best[0].cigar == "1M1D2M" and best[0].start_a == 0
    local = _aligned(spark, "xxACGTyy", "zACGTz", align.Cost(2, -3, -3, -1, 0), align.LOCAL)
    assert local[0].score == 8 and local[0].cigar == "1S4M1S" and local[0].start_a == 2
    semi = _aligned(spark, "xxACGT", "ACGTyy", align.Cost(2, -3, -3, -1, 0), align.SEMI)
    assert semi[0].score == 8 and semi[0].start_a == 2
    assert _aligned(spark, "", "AB", align.Cost(), align.GLOBAL)[0].score == -2


def test_alignment_close_costs_and_all_paths(spark):
    both = _aligned(spark, "AAA", "AA", align.Cost(1, -1, -1, -1, -1), align.GLOBAL, 10)
    assert {r.cigar for r in both} == {"1D2M", "1M1D1M", "2M1D"} and {r.score for r in both} == {-1.0}


def brute_alignments(a, b, cost, ends):
    """All alignments as (score, path), by recursion over every path."""
    out = []

    def walk(x, y, state, score, path):
        leave = cost.close if state in "XY" else 0
        if ends == align.GLOBAL:
            if (x, y) == (len(a), len(b)):
                out.append((score + leave, tuple(path)))
        elif state == "M" and (ends == align.LOCAL or x == len(a) or y == len(b)):
            out.append((score, tuple(path)))
        if x < len(a) and y < len(b):
            walk(x + 1, y + 1, "M", score + leave + cost.of(a[x], b[y]), [*path, (x, y)])
        for state2, dx, dy in (("X", 1, 0), ("Y", 0, 1)):
            if x + dx <= len(a) and y + dy <= len(b) and (ends == align.GLOBAL or path):
                enter = cost.extend if state == state2 else cost.extend + cost.open + leave
                walk(x + dx, y + dy, state2, score + enter, [*path, (x if dx else -1, y if dy else -1)])

    starts = [(0, 0)] if ends == align.GLOBAL else [(x, y) for x in range(len(a) + 1) for y in range(len(b) + 1) if ends == align.LOCAL or x == 0 or y == 0]
    for x, y in starts:
        walk(x, y, "M", 0, [])
    return out


@pytest.mark.parametrize("ends", [align.GLOBAL, align.SEMI, align.LOCAL])
@pytest.mark.parametrize(("a", "b"), [("ACA", "AAC"), ("AB", "B"), ("", "A"), ("AC", "CA")])
def test_all_alignments(ends, a, b):
    cost = align.Cost(2, -1, -2, -1, -1)
    c = align.spread(a, b, cost)
    t = align.tables(c, ends)
    want = brute_alignments(a, b, cost, ends)
    best = max(s for s, _ in want)
    assert max(s for s, *_ in align.endings(t, c, ends)) == best
    if ends == align.GLOBAL:
        got = [(s, tuple(p)) for s, p in align.paths(t, c, ends, best - 6, 1000, 1000)]
        assert set(got) == {(s, p) for s, p in want if s >= best - 6} and len(got) == len(set(got))
        assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
    else:
        got = {(s, tuple(p)) for s, p in align.paths(t, c, ends, best, 1, 1000)}
        assert got <= {(s, p) for s, p in want if s == best} and got


def test_alignment_regions(spark):
    hard = align.Region(align.Cost(-5, -5, -9, -9, 0), 1, 2, 1, 2)
    pairs = spark.createDataFrame([(0, "AAA", "AAA")], "pair_id long, a string, b string")
    assert align.align(pairs, align.Cost(1, -1, -1, -1, 0), align.GLOBAL, regions=[align.Region(align.Cost(9, 9, -50, -50, 0), 0), hard]).first().score == 9 - 5 + 9
    assert align.align(pairs, align.Cost(1, -1, -4, -1, 0), align.GLOBAL, regions=[align.Region(align.Cost(7, 7, -4, -1, 0), 2)]).first().score == 9


def test_costs():
    assert align.parse_cost("-3 -1 0 2 A C 1 -1 -1 1").of("A", "C") == -1
    assert align.parse_cost("-3 -1 0 1 A 5").of("A", "X") == 0
    assert align.mangle(5, "+ 3 * 2 - 1 / 5 = 9") == 9 and align.mangle(5, "+ 3 * 2") == 16
    for bad in ("+", "% 3"):
        with pytest.raises(ValueError):
            align.mangle(5, bad)
    with pytest.raises(ValueError):
        align.parse_cost("1 2")


def test_cost_changes():
    base = align.parse_cost("-3 -1 0 2 A C 1 -1 -1 1")
    changed = align.change_costs(base, "~ A C + 5\nGo * 2\nGx = -7\n~ C C - 1 * 3")
    assert (changed.of("A", "C"), changed.of("C", "A"), changed.of("C", "C")) == (4, -1, 0)
    assert (changed.open, changed.extend, changed.close) == (-6, -7, 0)
    for bad in ("~ A", "~ A C + 1\n~ A C + 2", "Gz + 1", "Go + 1\nGo + 2", "x"):
        with pytest.raises(ValueError):
            align.change_costs(base, bad)


def test_suffix_array_with_ends_and_bounds(spark, seqs, patterns):
    ended = suffix.build_direct(seqs, with_end=True)
    got = [(r.seq_ind, r.char_ind) for r in ended.orderBy("rank").collect()]
    assert got == [(0, 6), (1, 5), *ARRAY]
    index = suffix.with_head(suffix.build(seqs), seqs, 3)
    got = {r.look_for: (r.low, r.high) for r in suffix.bounds(index, patterns, 3).collect()}
    assert got == {0: (2, 5), 1: (5, 9), 2: (3, 5)}
    with pytest.raises(ValueError):
        suffix.dump(index, seqs, -1)
    assert suffix.dump(index, seqs, 0).first().bases == ""


def test_peptide_search(spark, seqs, patterns):
    named = seqs.withColumn("name", F.concat(F.lit("P"), F.col("seq_ind").cast("string"), F.lit("_v")))
    bed = spark.createDataFrame([(0, "chr1", 100, 118, "P0", "+")], "ord long, chrom string, start long, end long, name string, strand string")
    rows = spark.createDataFrame([(0, "P0_v", "i1", "6M", "4-5A>B:1C>T"), (1, "P0_v", "i2", "6M", None), (2, "P1_v", "i1", "5M", None)], "ord long, name string, ind string, cigar string, dif string")
    ids = spark.createDataFrame([("P0", "T0", "G0")], "protein string, transcript string, gene string")
    run = peptides.search_peptides(patterns.where("look_for < 4"), named, proteins.protein_rollup(bed), proteins.variant_rollup(rows), ids, rules="[4B52]|-[4B52]|!\n^|-[4B52]|!")
    assert [tuple(r)[1:5] for r in run.matches.orderBy("match_ind").collect()] == [(0, 1, 0, 2), (0, 1, 2, 4)]
    report = {(r.look_for, r.match_ind): r for r in run.report.collect()}
    assert set(report) == {(0, 0), (0, 1), (1, None), (2, None), (3, None)} and report[0, 0].protein == "P1" and not report[3, None].found
    assert {r.look_for: r.n_owners for r in run.frequencies.collect()} == {0: 1, 1: 0, 2: 0, 3: 0}
    free = peptides.search_peptides(patterns.where("look_for = 0"), named, proteins.protein_rollup(bed), proteins.variant_rollup(rows), ids)
    hit = free.report.where("protein = 'P0'").first()
    assert (hit.location, hit.near_variants, hit.owners, hit.gene) == ("chr1:112-117", "4-5A>B:1C>T", "i1|i2", "G0")


def test_regions_and_boxes(spark):
    points = spark.createDataFrame([(0, 5, 5), (1, 50, 5)], "point_id long, a long, b long")
    regions = spark.createDataFrame([(0, -1, -1, -1, -1, 1), (1, 0, 10, 0, 10, 2), (2, 0, -1, -1, -1, 3)], "region_id long, start_a long, end_a long, start_b long, end_b long, cost long")
    assert {r.point_id: r.cost for r in alignments.region_costs(points, regions).collect()} == {0: 2, 1: 3}
    boxes = spark.createDataFrame([(0, -1, -1, -1, -1, 1), (1, 0, 9, -1, -1, 2), (2, 3, 9, -1, -1, 3)], "ord long, low_q long, high_q long, low_r long, high_r long, cost long")
    got = alignments.most_constrained(points.select("point_id", F.col("a").alias("q"), F.col("b").alias("r")), boxes)
    assert {r.point_id: r.cost for r in got.collect()} == {0: 2, 1: 1}


def test_mates(spark):
    rows = spark.createDataFrame([("r", i) for i in range(5)] + [("s", 9)], "name string, ord long")
    pairs, waiting = alignments.mate_pairs(rows)
    assert sorted((r.pair_ind, r.first.ord, r.second.ord) for r in pairs.collect()) == [(0, 0, 1), (1, 2, 3)]
    assert sorted(r.first.ord for r in waiting.collect()) == [4, 9]


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one two\nAC GT\nTT\n>empty\n\n>x\nA>C\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@q 1\nACGT\n+\nIII!\n")
    got = sequences.read_sequences(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fq.gz")]).orderBy("seq_ind").collect()
    assert [(r.seq_ind, r.name, r.short_name, r.seq) for r in got] == [(0, "one two", "one", "ACGTTT"), (1, "empty", "empty", ""), (2, "x", "x", "A>C"), (3, "q 1", "q", "ACGT")]
    assert got[0].qual is None and got[3].qual == [-4.0, -4.0, -4.0, 0.0]
    assert sorted((r.name, r.seq) for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("empty", ""), ("one two", "ACGTTT"), ("x", "A>C")]
    for bad in (">\nA\n", "@q\nAC\n+\nI\n", "@q\nAC\n", "junk\n"):
        with pytest.raises(ValueError):
            list(sequences.parse_records(iter(bad.splitlines(keepends=True))))


def test_sequence_parts(spark, seqs):
    wanted = spark.createDataFrame([(0, 1, 3), (1, 0, 0)], "seq_ind long, start long, end long")
    assert {tuple(r) for r in sequences.subsequence(seqs, wanted).collect()} == {(0, 1, 3, "KR"), (1, 0, 0, "")}
    fails(spark, sequences.subsequence(seqs, wanted.withColumn("end", F.lit(99).cast("long"))), "Bad sequence")


def test_binary_matches(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"".join(struct.pack(">QQQQ", *m) for m in sorted(FOUND)))
    got = match_files.read_matches(spark, str(tmp_path / "m.bin"))
    assert [tuple(r)[1:] for r in got.orderBy("ord").collect()] == sorted(FOUND)
    assert match_files.match_bytes(got.where("ord = 0")).first().record == struct.pack(">QQQQ", *min(FOUND))
    (tmp_path / "bad.bin").write_bytes(b"123")
    for read, message in ((match_files.read_matches, "Incomplete match"), (match_files.read_suffix_array, "Malformed combo")):
        with pytest.raises(ValueError, match=message):
            read(spark, str(tmp_path / "bad.bin"))


def test_record_files_of_many_parts(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("n"), *((F.col("id") * k - 5).alias(c) for k, c in enumerate(match_files.MATCH))).repartition(5)
    match_files.write_records(rows, "n", match_files.MATCH, str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").iterdir()) == 20_000 * 32 and not list((tmp_path / "out").glob("_*"))
    with pytest.raises(Exception, match="not empty"):
        match_files.write_records(rows, "n", match_files.MATCH, str(tmp_path / "out"))
    (tmp_path / "out" / "part-000002a.bin").write_bytes(b"")
    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("mapreduce.input.fileinputformat.split.maxsize", "50000")
    try:
        got = match_files.read_matches(spark, str(tmp_path / "out"))
        assert got.rdd.getNumPartitions() > 10
        want = {r.n: tuple(r)[1:] for r in rows.collect()}
        assert {r.ord: tuple(r)[1:] for r in got.collect()} == want and got.count() == 20_000
    finally:
        hadoop.unset("mapreduce.input.fileinputformat.split.maxsize")
    (tmp_path / "none").mkdir()
    assert match_files.read_suffix_array(spark, str(tmp_path / "none")).count() == 0


def test_sam_and_bam(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "r1\t99\tchr1\t7\t30\t4M\t=\t37\t39\tACGT\tIIII\tNM:i:1", "r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    sam = genomics.sam(df)
    first = sam.where("name = 'r1'").first()
    assert (first.pos, first.next_pos, first.extra, first.cigar) == (6, 36, "NM:i:1", "4M")
    assert sam.where("name = 'r2'").first().pos == -1
    assert {r.value for r in genomics.sam_lines(sam).collect()} == set(lines)
    fails(spark, genomics.sam(spark.createDataFrame([("r\t1",)], "value string")), "too few columns")
    fails(spark, genomics.sam(spark.createDataFrame([(lines[1].replace("IIII", "III"),)], "value string")), "differ in length")

    tags = b"NMc\x01" + b"XXZab\0" + b"XBBs\x02\0\0\0\x01\0\xff\xff" + b"XAAq" + b"XFf" + struct.pack("<f", 0.5)
    body = struct.pack("<iiBBHHHiiii", 0, 6, 3, 30, 0, 2, 99, 4, 0, 36, 39) + b"r1\0" + struct.pack("<II", 3 << 4, 1 << 4 | 1) + bytes([0x12, 0x48]) + bytes([40] * 4) + tags
    bam = b"BAM\1" + struct.pack("<i", 11) + b"@HD\tVN:1.6\n" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 99) + struct.pack("<i", len(body)) + body
    (tmp_path / "x.bam").write_bytes(gzip.compress(bam))
    head, r = genomics.read_alignments(spark, str(tmp_path / "x.bam")).collect()
    assert head.is_header and head.header == "@HD\tVN:1.6"
    assert (r.name, r.flag, r.ref, r.pos, r.cigar, r.next_ref, r.seq, r.qual) == ("r1", 99, "chr1", 6, "3M1I", "chr1", "ACGT", "IIII")
    assert r.extra == "NM:i:1\tXX:Z:ab\tXB:B:s,1,-1\tXA:A:q\tXF:f:0.5"


def test_graphs(spark):
    assert genomics.parse_graph("A&x;C[y x]G&y;T[x /]A") == ("ACGTA", [("x", 1), ("y", 3)], [(2, 3), (2, 1), (2, 2), (4, 1)])
    for bad in ("&x", "[a", "[]", "a]", "[q]"):
        with pytest.raises(ValueError):
            genomics.parse_graph(bad)
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 5, 6), (0, 6, 5), (0, 6, 7)], "graph_id long, src long, dst long")
    assert {(r.src, r.dst) for r in graphs.flatten(edges).collect()} == {(0, 1), (1, 2), (2, 3), (5, 6), (6, 5), (6, 7), (3, 3), (7, 7)}
    near = graphs.neighbourhood(edges, spark.createDataFrame([(0, 2)], "graph_id long, node long"), 1)
    assert {(r.node, r.distance) for r in near.collect()} == {(2, 0), (1, 1), (3, 1)}
    assert {(r.src, r.new_src, r.new_dst) for r in graphs.subgraph(edges, near).collect()} == {(1, 0, 1), (2, 1, 2)}
    assert {r.node: r.layer for r in graphs.topological_layers(edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 5: -1, 6: -1, 7: -1}


def test_settings():
    assert genomics.settings("; c\n# d\na = 1\n\nb=x=y") == {"a": "1", "b": "x=y"}
    with pytest.raises(ValueError):
        genomics.settings("oops")


def test_keyed_lines_and_people(spark):
    lines = spark.createDataFrame([("a 1",), ("",), (" b 2 ",), ("a 3",)], "value string")
    fails(spark, tsv.keyed_lines(lines), "Duplicate key: a")
    assert {tuple(r) for r in tsv.keyed_lines(lines.where("value <> 'a 3'")).collect()} == {("a", "a 1"), ("b", "b 2")}
    assert sorted(r.name for r in tsv.people(lines).collect()) == ["a 1", "a 3", "b 2"]


def test_escapes_keep_every_character(spark):
    texts = ["a\0b", "\\n", "\\\\t", "\\", "\n\t\r", "\0\\\0", "", "x\\y\\"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    back = df.select("i", tsv.unescape(tsv.escape(F.col("t"))).alias("t"), tsv.unescape(F.lit("\\\\n\\n\\\\")).alias("u"))
    assert {r.i: r.t for r in back.collect()} == dict(enumerate(texts)) and back.first().u == "\\n\n\\"


def test_sam_files_keep_their_order_in_all_tasks(spark):
    lines = [f"r{i}\t0\t*\t1\t0\t*\t*\t0\t0\t*\t*" for i in range(3000)]
    lines[1000:1000] = ["@HD\tVN:1", "@CO\tlater"]
    path, df = f"{shared_dir(spark)}/{uuid.uuid4().hex}", spark.createDataFrame([(x,) for x in lines], "value string").repartition(1)
    genomics.write_sam(genomics.sam(df), path)
    rows = spark.read.text(path).select("value", "_metadata.file_name").collect()
    files = {}
    for r in rows:
        files.setdefault(r.file_name, []).append(r.value)
    assert len(files) > 2 and max(map(len, files.values())) < 2500
    assert [x for f in sorted(files) for x in files[f]] == ["@HD\tVN:1", "@CO\tlater", *(x for x in lines if x[0] != "@")]


def test_log_sums_of_hot_groups_and_extremes(spark):
    rows = [("hot", -1.5)] * 5000 + [("wide", 300.0), ("wide", -300.0), ("low", float("-inf")), ("low", -2.0), ("none", None), (None, -1.0)]
    df = spark.createDataFrame(rows, "g string, p double")
    got = {r.g: r.log10_sum for r in tables.log10_total(df, ["g"], "p").collect()}
    assert got["hot"] == pytest.approx(-1.5 + math.log10(5000)) and got["wide"] == pytest.approx(300) and got["low"] == pytest.approx(-2) and math.isnan(got["none"]) and got[None] == -1
    assert math.isnan(tables.log10_total(df.limit(0), [], "p").first().log10_sum) and tables.log10_total(df.limit(0), ["g"], "p").count() == 0


def test_range_joins_of_skewed_points(spark):
    rng = random.Random(3)
    points = [(i, rng.choice([0, 0, 0, 1, 5, 10**6]), rng.choice([7, 7, rng.randrange(100)])) for i in range(300)]
    boxes = [(i, *(rng.choice([-1, rng.randrange(60)]) for _ in range(4)), i) for i in range(40)]
    inside = lambda p, b: (b[1] < 0 or p[1] >= b[1]) and (b[2] < 0 or p[1] < b[2]) and (b[3] < 0 or p[2] >= b[3]) and (b[4] < 0 or p[2] < b[4])
    want = {p[0]: max(((min(b[1:5]) >= 0, b[0]) for b in boxes if inside(p, b)), default=(0, None))[1] for p in points}
    got = alignments.region_costs(spark.createDataFrame(points, "point_id long, a long, b long"), spark.createDataFrame(boxes, "region_id long, start_a long, end_a long, start_b long, end_b long, cost long"))
    assert {r.point_id: r.cost for r in got.collect()} == want


def test_dense_ranks_of_equal_keys(spark):
    rows = [(None, 1), (None, 1), ("a", None), ("a", 2), ("a", 2), ("b", 0)] + [("hot", 1)] * 500
    got = with_dense_rank(spark.createDataFrame(rows, "x string, y long"), ["x", "y"]).collect()
    assert len(got) == len(rows) and {(r.x, r.y): r["rank"] for r in got} == {(None, 1): 0, ("a", None): 1, ("a", 2): 2, ("b", 0): 3, ("hot", 1): 4}


def test_log_sums(spark):
    df = spark.createDataFrame([("a", -400.0), ("a", -400.0), ("b", -1.0)], "g string, p double")
    got = {r.g: r.log10_sum for r in tables.log10_total(df, ["g"], "p").collect()}
    assert got["a"] == pytest.approx(-400 + 0.30103, abs=1e-5) and got["b"] == -1
    assert tables.log10_total(df, [], "p").first().log10_sum == pytest.approx(-1)


def test_layers_of_deep_and_odd_graphs(spark):
    deep = [(0, i, i + 1) for i in range(10_100)]
    bubbles = [(1, a, b) for i in range(0, 300, 3) for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3), (i, i + 3))]
    cycles = [(2, 1, 2), (2, 2, 3), (2, 3, 1), (2, 3, 4), (2, 5, 4), (2, 5, 6), (2, 7, 7), (3, 0, 1), (3, 1, 2), (3, 2, 1), (3, 8, 9)]
    rng = random.Random(6)
    dense = [(4, a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(90)) if a < b or rng.random() < 0.02]
    rows = deep + bubbles + cycles + dense
    want, before = {}, {}
    for g, a, b in rows:
        before.setdefault((g, a), set())
        before.setdefault((g, b), set()).update({(g, a)} - {(g, b)})
    free = [x for x, p in before.items() if not p]
    after = {}
    for x, p in before.items():
        for y in p:
            after.setdefault(y, []).append(x)
    layer = 0
    while free:
        want |= dict.fromkeys(free, layer)
        ready = []
        for y in free:
            for x in after.get(y, []):
                before[x].discard(y)
                if not before[x]:
                    ready.append(x)
        free, layer = ready, layer + 1
    want = dict.fromkeys(before, -1) | want
    got = graphs.topological_layers(spark.createDataFrame(rows, "graph_id long, src long, dst long")).collect()
    assert len(got) == len(want) and {(r.graph_id, r.node): r.layer for r in got} == want
    assert want[0, 10_100] == 10_100 and want[1, 300] == 200 and want[2, 4] == want[3, 2] == -1


def brute_order(edges):
    """(node, component, layer) by reachability of a small graph."""
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    comp = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    layer = dict.fromkeys(comp.values(), 0)
    for _ in nodes:
        for a, b in edges:
            if comp[a] != comp[b]:
                layer[comp[b]] = max(layer[comp[b]], layer[comp[a]] + 1)
    return {(n, comp[n], layer[comp[n]]) for n in nodes}


def test_cycles_are_one_group_and_what_lies_behind_has_layers(spark):
    rng = random.Random(6)
    drawn = {g: [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.choice([3, 10, 18]))] for g in range(12)}
    drawn[100] = [(i, (i + 1) % 40) for i in range(40)] + [(7, 99), (99, 98), (98, 7), (98, 200), (300, 3), (5, 5)]
    edges = spark.createDataFrame([(g, a, b) for g, es in drawn.items() for a, b in es] + [(None, 1, 2)], "graph_id long, src long, dst long")
    got = graphs.topological_order(edges).collect()
    assert {(r.graph_id, r.node, r.component, r.layer) for r in got} == {(g, *x) for g, es in drawn.items() for x in brute_order(es)} and len(got) == len(set(got))
    assert graphs.topological_order(edges.limit(0)).count() == 0


def test_fastq_by_lines(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@one x\nACGT\n+\n@@II\r\n@two\n\n+two\n\n@three\r\nA\r\n+\r\n+\r\n")
    (tmp_path / "b.fq").write_text("@four\nAC\n+\n!~")
    got = sequences.read_fastq(spark, str(tmp_path)).orderBy("seq_ind").collect()
    assert [(r.seq_ind, r.name, r.short_name, r.seq) for r in got] == [(0, "one x", "one", "ACGT"), (1, "two", "two", ""), (2, "three", "three", "A"), (3, "four", "four", "AC")]
    assert got[0].qual == pytest.approx([-3.1, -3.1, -4.0, -4.0]) and got[1].qual == []
    for bad in ("@x\nAC\n+\nI\n", "@x\nAC\n+\n", "x\nAC\n+\nII\n", "@ \nA\n+\nI\n"):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / "c.fq").write_text(bad)
        with pytest.raises(Exception, match="Incomplete record"):  # records are numbered at once
            sequences.read_fastq(spark, str(tmp_path / "bad")).collect()


def test_protein_and_variant_text(spark):
    cells = [["P1", "LOCS{", "chr1", "5", "9", "-", "chr2", "x", "3", "?", "}SCOL"], ["P2", "LOCS{", "}SCOL"], ["P3"], ["P4", "LOCS{", "chr1", "5", "}SCOL"]]
    rows = spark.createDataFrame([(c,) for c in cells], "cells array<string>")
    got = {r.name: [tuple(x) for x in r.locs] for r in proteins.parse_protein_cells(rows).collect()}
    assert got == {"P1": [("chr1", 5, 9, False), ("chr2", 0, 3, True)], "P2": [], "P3": [], "P4": []}
    cells = [["V1", "5M", "INDS{", "a", "b", "}SDNI", "DIFS{", "d", "}SFID"], ["V2", "4M", "INDS{", "a", "}SDNI"], ["V3"], ["V4", "INDS{", "}SDNI", "DIFS{", "}SFID"]]
    rows = proteins.parse_variant_cells(spark.createDataFrame([(c,) for c in cells], "cells array<string>"))
    assert sorted((r.name, r.cigar, r.inds, r.difs) for r in rows.collect()) == [("V1", "5M", ["a", "b"], ["d"]), ("V2", "4M", ["a"], []), ("V3", "???", [], []), ("V4", "???", [], [])]
    assert [r.cells for r in proteins.variant_cells(rows.where("name = 'V1'")).collect()] == [["V1", "5M", "INDS{", "a", "b", "}SDNI", "DIFS{", "d", "}SFID"]]


def test_small_graphs_are_ordered_without_rounds(spark, monkeypatch):
    rng = random.Random(5)
    drawn = {g: [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randint(1, 14))] for g in range(40)}
    drawn[90] = [(i * 2, i * 2 + 1) for i in range(graphs.SMALL_EDGES)]  # as many nodes as there are bits
    drawn[91] = [(i, i + 1) for i in range(graphs.SMALL_EDGES)]
    writes, staged = [], graphs.staged
    monkeypatch.setattr(graphs, "staged", lambda df, name: (writes.append(name), staged(df, name))[1])

    def check(drawn):
        edges = spark.createDataFrame([(g, a, b) for g, es in drawn.items() for a, b in es] + [(0, None, 7), (0, 8, None), (None, 1, 2)], "graph_id long, src long, dst int")
        got = graphs.topological_order(edges).collect()
        want = {(g, *x) for g, es in drawn.items() for x in brute_order(es + [(7, 7), (8, 8)] * (g == 0))}
        assert {(r.graph_id, r.node, r.component, r.layer) for r in got} == want and len(got) == len(set(got))

    check(drawn)
    assert len(writes) == 1
    drawn[92] = drawn[91] + [(graphs.SMALL_EDGES, 3)]  # goes in rounds
    check(drawn)
    assert len(writes) > 5


def test_components_of_random_graphs_and_long_rings(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(g, rng.randrange(30), rng.randrange(30)) for g in range(4) for _ in range(18 + 8 * g)]
    edges += [(9, i, (i + 1) % 120) for i in range(120)] + [(9, 200, 5), (9, 40, 300), (9, 300, 301), (9, 301, 302), (9, 302, 301), (9, 301, 300)]
    reach = {}
    for g, a, b in edges:
        reach.setdefault((g, a), set()).add((g, b))
        reach.setdefault((g, b), set())

    def all_from(x):
        seen, todo = {x}, [x]
        while todo:
            new = reach[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    closed = {x: all_from(x) for x in reach}
    want = {x: min(y[1] for y in closed[x] if x in closed[y]) for x in reach}
    writes = []
    monkeypatch.setattr(graphs, "staged", lambda df, name: (writes.append(name), staged(df, name))[1])
    got = {(r.graph_id, r.node): r.component for r in graphs.strong_components(spark.createDataFrame(edges, "graph_id long, src long, dst long")).collect()}
    assert got == want
    assert len(writes) < 100  # a round for each step around the ring of 120 would write 240 tables at least


def test_genome_location_of_missing_values(spark):
    """Rows of one batch with missing lists, exons, names, ends and matches."""
    exon = "array<struct<chrom:string,start:bigint,end:bigint,positive:boolean>>"
    rows = [
        (0, None, "4M", 0, 2, None, "No location."), (1, [None, ("c", 3, 9, True)], "4M", 0, 2, "", "CIGAR beyond location."), (2, [("c", 10, 16, None)], "4M", 0, 2, "c:10-15", "CIGAR beyond location."),
        (3, [("c", 0, 3, False), ("c", 3, None, False), ("d", 5, 8, False)], "2M", 0, 2, "c:7-5|c:2-0", "Multiple chromosomes."), (4, [("c", 0, 6, True)], None, None, 2, "", "Missing CIGAR."),
        (5, [("c", 0, 6, True)], "1M2I", 0, None, "", ""), (6, [(None, 0, 6, True)], "1M2I1M", 0, 4, "-1", ""), (7, [("c", 5, 8, True), ("c", 8, 11, True)], "2S2M", 0, 2, "c:5-10", "Bad CIGAR: Soft clip in the CIGAR of a protein."),
    ]
    data = spark.createDataFrame([r[:5] for r in rows], f"id int, locs {exon}, cigar string, a int, b int").coalesce(1)
    where = genome.genome_location(F.col("locs"), F.col("cigar"), F.col("a"), F.col("b"))
    got = data.select("id", where.alias("w"))
    assert "lambdafunction" not in got._jdf.queryExecution().analyzed().toString()  # not worked out element by element
    got = {r.id: (r.w.location, "|".join(r.w.warnings)) for r in got.collect()}
    assert got == {r[0]: r[5:] for r in rows}


def test_proteins_and_variants_may_lack_their_lists(spark):
    found = spark.createDataFrame([(1, "P1_x"), (2, "P2_x"), (3, None)], "id int, name string")
    sizes = spark.createDataFrame([("P1", 3)], "name string, n_locs int"), spark.createDataFrame([("P2_x", 4, 1)], "name string, n_inds int, n_cigars int")
    rows = proteins.with_proteins(found, *sizes)
    assert sorted(rows.columns) == ["id", "n_inds", "n_locs", "name", "protein"]
    assert sorted((r.id, r.n_locs, r.n_inds) for r in rows.collect()) == [(1, 3, None), (2, None, 4), (3, None, None)]


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    """Splits that share a row group: one of them has all rows, the others none."""
    part, lines = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", [(i // 4, i % 4 + 1, i, i % 7) for i in range(2000)]
    spark.createDataFrame(lines, part).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        for query in (catalogue.genome_location, catalogue.genome_location_exons, catalogue.near_match, catalogue.near_match_cigars):
            rows = query(spark, str(tmp_path))
            counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
            assert len(counts) == spark.sparkContext.defaultParallelism and max(counts) < sum(counts) / 2, query
        assert catalogue.genome_location(spark, str(tmp_path)).distinct().count() == len(lines)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_cigars_of_one_operation(spark):
    for cigar, error in (("12M", None), ("3P", None), ("1H", None), ("0=", None), ("5Q", "Unknown operation in CIGAR."), ("4M\n", "Unknown operation in CIGAR."), ("4\u0664M", "Unknown operation in CIGAR."), ("4", "Count without an operation in CIGAR."), ("", None), (None, None)):
        assert one(spark, genome.cigar_error(F.lit(cigar).cast("string"))) == error, cigar

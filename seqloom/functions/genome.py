"""Scalar functions on alignments, coordinates and differences, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: SAM flag bits, fixed by the format.
PAIRED, PROPER_PAIR, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
FIRST, LAST, SECONDARY, FAILED_QC, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048

def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside lambdas an expression is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_flag(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def is_primary(flag: Column) -> Column:
    return ~has_flag(flag, SECONDARY | SUPPLEMENTARY)


def needs_pair(flag: Column) -> Column:
    return has_flag(flag, PAIRED)


def is_alignment(flag: Column, pos: Column, cigar: Column) -> Column:
    return ~has_flag(flag, UNMAPPED) & ~(has_flag(flag, FIRST) & has_flag(flag, LAST)) & (pos >= 0) & F.coalesce(cigar.rlike("[M=X]"), F.lit(False))


def cigar_error(cigar: Column) -> Column:
    """What is wrong with a CIGAR, null if nothing is.  Missing values are not an error."""
    # the order of operations is looked at without their counts: plain classes, which match texts of any length
    kinds = F.regexp_replace(cigar, "[0-9]+", "")
    shape = cigar.rlike("^[^0-9]|[^0-9][^0-9]|[0-9]$") | kinds.rlike("[^MIDNSHP=X]")
    order = kinds.rlike("^[HP]*[SP]*[MIDNP=X]*[SP]*[HP]*$")
    # one operation, as most have, can't be out of order
    one = cigar.rlike("^[0-9]+[MIDNSHP=X]\\z")
    return F.when(one, F.lit(None).cast("string")).when(~shape & order, F.lit(None).cast("string")).otherwise(
        F.when(cigar.rlike("-[0-9]*[A-Z=]"), "Negative count in CIGAR.")
        .when(cigar.rlike("(^|[A-Z=])[A-Z=]"), "Operation without a count in CIGAR.")
        .when(cigar.rlike("[0-9]$"), "Count without an operation in CIGAR.")
        .when(shape, "Unknown operation in CIGAR.")
        .when(~order, "Operation after a clip in CIGAR.")
    )


_RUN = StructType([StructField(c, LongType()) for c in ("at", "n", "ref")])
_RUNS = StructType([*(StructField(c, LongType()) for c in ("soft_start", "soft_end", "length")), StructField("runs", ArrayType(_RUN))])
#: Codes of operations: mapped, inserted, skipped in the reference, soft clip, nothing.
_KIND = np.full(256, 4)
for _i, _letters in enumerate((b"M=X", b"I", b"DN", b"S")):
    _KIND[list(_letters)] = _i


def _parsed(cigars: pa.Array, starts: pa.Array) -> pa.Array:
    """Runs of well-formed CIGARs, all of a batch at once; null for null."""
    rows, missing = len(cigars), pc.is_null(cigars)
    starts = pc.fill_null(starts, 0).to_numpy(zero_copy_only=False)
    cigars = pc.fill_null(cigars, "").cast(pa.large_binary())
    offsets = np.frombuffer(cigars.buffers()[1], np.int64)[cigars.offset : cigars.offset + rows + 1]
    data = np.frombuffer(cigars.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
    offsets = offsets - offsets[0]
    ends = np.flatnonzero((data < 48) | (data > 57))  # of counts: where the operations stand
    digits = np.flatnonzero((data >= 48) & (data <= 57))
    op = np.searchsorted(ends, digits)
    n = np.zeros(len(ends), np.int64)
    np.add.at(n, op, (data[digits] - 48) * 10 ** np.minimum(ends[op] - 1 - digits, 18))
    row, kind = np.searchsorted(offsets, ends, side="right") - 1, _KIND[data[ends]]
    first = np.searchsorted(row, np.arange(rows))

    def before(some: np.ndarray) -> np.ndarray:
        """The sum of what stands before each operation in its CIGAR."""
        total = np.concatenate([[0], np.cumsum(some)])
        return total[:-1] - total[first[row]]

    ref, at, seen = before(n * np.isin(kind, (0, 2))) + starts[row], before(n * (kind <= 1)), before(kind <= 2) > 0
    sums = lambda some: np.bincount(row[some], n[some], rows).astype(np.int64)
    keep = (kind <= 1) & (n > 0)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=rows))]).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(at[keep]), pa.array(n[keep]), pa.array(np.where(kind == 0, ref, -1)[keep])], ["at", "n", "ref"])
    columns = [pa.array(sums((kind == 3) & ~seen)), pa.array(sums((kind == 3) & seen)), pa.array(sums(kind <= 1)), pa.ListArray.from_arrays(pa.array(bounds), runs)]
    return pa.StructArray.from_arrays(columns, ["soft_start", "soft_end", "length", "runs"], mask=missing)


_runs_of = F.arrow_udf(_RUNS)(_parsed)


def cigar_runs(cigar: Column, start: Column | int = 0) -> Column:
    """struct(soft_start, soft_end, length, runs): what stretches of the read's ``length`` bases align to.

    A run is (at, n, ref): n bases from ``at`` on, the first at reference position ``ref``, or -1 if they are inserted.  M, =
    and X take a base of both, I one of the read, D and N skip reference, S counts as clipped, H and P do nothing.  Null if
    the CIGAR is missing or malformed (see ``cigar_error``).
    """
    start = F.lit(start) if isinstance(start, int) else start
    return _runs_of(F.when(cigar_error(cigar).isNull(), cigar), start.cast("long"))


def cigar_positions(cigar: Column, start: Column | int = 0) -> Column:
    """struct(soft_start, soft_end, positions): the runs with a reference position for every read base, -1 for inserted ones."""

    def spelled(parsed: Column) -> Column:
        spell = lambda r: F.when(r["ref"] >= 0, F.sequence(r["ref"], r["ref"] + r["n"] - 1)).otherwise(F.array_repeat(F.lit(-1).cast("long"), r["n"].cast("int")))
        positions = F.flatten(F.transform(parsed["runs"], spell))
        return F.when(parsed.isNotNull(), F.struct(parsed["soft_start"].alias("soft_start"), parsed["soft_end"].alias("soft_end"), positions.alias("positions")))

    return bound(cigar_runs(cigar, start), spelled)


def cigar_bounds(runs: Column) -> Column:
    """struct(first, last): the smallest and largest reference position of runs, -1 if no base is mapped."""
    mapped = F.filter(runs, lambda r: r["ref"] >= 0)
    end = lambda edge: F.array_max(F.transform(mapped, edge)) if edge is last else F.array_min(F.transform(mapped, edge))
    first, last = (lambda r: r["ref"]), (lambda r: r["ref"] + r["n"] - 1)
    return F.struct(F.coalesce(end(first), F.lit(-1).cast("long")).alias("first"), F.coalesce(end(last), F.lit(-1).cast("long")).alias("last"))


def ucsc(text: Column) -> Column:
    """struct(ref, start, end, warning) of ``chr:a-b`` or ``chr:a`` (one base)."""
    pattern = r"^([^:]+):([0-9]+)(?:-([0-9]+))?$"
    ok = text.rlike(pattern)
    a, b = F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 3)
    start = F.when(ok, a.try_cast("long"))
    return F.struct(
        F.when(ok, F.regexp_extract(text, pattern, 1)).alias("ref"),
        start.alias("start"),
        F.when(ok, F.when(b == "", start + 1).otherwise(b.try_cast("long"))).alias("end"),
        F.when(~ok, F.concat(F.lit("Malformed coordinate: "), text)).alias("warning"),
    )


def difference(text: Column) -> Column:
    """struct(desc, warning, prot_start, prot_end, prot_change, gen_loc, gen_change) of ``167-168S>F:109130043C>T``."""
    halves = F.split(text, ":", -1)
    protein, genome = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    ends = F.split(protein, "-", -1)
    first = F.regexp_extract(F.get(ends, F.lit(0)), "([0-9]+)", 1)
    last = F.regexp_extract(F.get(ends, F.lit(1)), "^[^0-9]*([0-9]+)", 1)
    place = F.regexp_extract(genome, "([0-9]+)", 1)
    ok = F.coalesce((F.size(halves) == 2) & (F.size(ends) == 2) & (first != "") & (last != "") & (place != ""), F.lit(False))
    return F.struct(
        text.alias("desc"),
        F.when(~ok, F.concat(F.lit("Questionable variant: "), text)).alias("warning"),
        F.when(ok, first.try_cast("long")).alias("prot_start"),
        F.when(ok, last.try_cast("long")).alias("prot_end"),
        F.when(ok, F.regexp_extract(F.get(ends, F.lit(1)), "^[^0-9]*[0-9]+(.*)$", 1)).alias("prot_change"),
        F.when(ok, place.try_cast("long")).alias("gen_loc"),
        F.when(ok, F.regexp_extract(genome, "[0-9]+(.*)$", 1)).alias("gen_change"),
    )


def differences(text: Column) -> Column:
    """array<difference> of a list joined by semicolons."""
    return F.transform(F.split(text, ";", -1), difference)


#: What stands for a CIGAR that is not known.
NO_CIGAR = "???"


def _given(cigar: Column) -> Column:
    return F.when(cigar != NO_CIGAR, cigar)


#: What keeps a protein's CIGAR that is well formed from placing a match.
_CLIPPED, _SHORT = "Soft clip in the CIGAR of a protein.", "Match beyond the end of the CIGAR."


def _protein_cigar_error(cigar: Column, parsed: Column, found_to: Column) -> Column:
    """What keeps a protein's CIGAR from placing a match, null if nothing does or there is none."""
    return F.when(
        cigar.isNotNull(),
        F.coalesce(cigar_error(cigar), F.when(parsed["soft_start"] + parsed["soft_end"] > 0, _CLIPPED).when(parsed["length"] < found_to, _SHORT)),
    )


def near_differences(diffs: Column, cigar: Column, found_at: Column, found_to: Column, within: Column | int = 0) -> Column:
    """Those of ``diffs`` whose protein range meets the match's range in the reference, widened by ``within`` on each side.

    The match's ends are carried through the CIGAR; an end that is inserted takes the nearest mapped base before it (low
    end) or after it (high end), else the nearest on its other side; if no base is mapped nothing is near.  Without a CIGAR
    (null or ``???``) residues are their own positions.  A malformed CIGAR, soft clips and a match beyond its end are errors.
    """
    within = F.lit(within) if isinstance(within, int) else within
    found_at, found_to, cigar = found_at.cast("long"), found_to.cast("long"), _given(cigar)

    def at(row: Column) -> Column:
        parsed, a, b = row["parsed"], row["a"], row["b"]
        mapped = F.filter(parsed["runs"], lambda r: r["ref"] >= 0)
        inside = F.filter(mapped, lambda r: (r["at"] < b) & (r["at"] + r["n"] > a))
        low = F.array_min(F.transform(inside, lambda r: r["ref"] + F.greatest(a - r["at"], F.lit(0))))
        high = F.array_max(F.transform(inside, lambda r: r["ref"] + F.least(b - r["at"], r["n"]) - 1))
        before = F.array_max(F.transform(F.filter(mapped, lambda r: r["at"] < a), lambda r: r["ref"] + F.least(a - r["at"], r["n"]) - 1))
        after = F.array_min(F.transform(F.filter(mapped, lambda r: r["at"] + r["n"] > b), lambda r: r["ref"] + F.greatest(b - r["at"], F.lit(0))))
        ends = F.struct((F.coalesce(low, before, high, after) - within).alias("low"), (F.coalesce(high, after, low, before) + within).alias("high"))
        return F.when(row["error"].isNotNull(), F.raise_error(row["error"]).cast("struct<low:bigint,high:bigint>")).otherwise(ends)

    def near(r: Column) -> Column:
        found = F.filter(diffs, lambda d: d["prot_start"].isNotNull() & (d["prot_start"] <= r["high"]) & (d["prot_end"] >= r["low"]))
        return F.when(r["low"].isNotNull(), found).otherwise(F.slice(diffs, F.lit(1), F.lit(0)))

    parsed = cigar_runs(F.coalesce(cigar, F.concat(found_to.cast("string"), F.lit("M"))))
    error = _protein_cigar_error(cigar, parsed, found_to)
    return bound(F.struct(parsed.alias("parsed"), error.alias("error"), found_at.alias("a"), found_to.alias("b")), lambda row: bound(at(row), near))


_LOCATION = StructType([StructField("location", StringType()), StructField("warnings", ArrayType(StringType()))])
#: Warnings in their order, with the place of an error in a CIGAR.
_WARNINGS = ["Multiple chromosomes.", "Both strands.", "Not whole codons.", "Missing CIGAR.", None, "CIGAR beyond location.", "No location."]


def _numbers(values: pa.Array, of_null: int | bool = 0) -> np.ndarray:
    return pc.fill_null(values, of_null).to_numpy(zero_copy_only=False)


def _before(some: np.ndarray) -> np.ndarray:
    """The sum of what stands before each number, and of all in the end."""
    return np.concatenate([[0], np.cumsum(some)])


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each element of lists of so many, and its place in its list."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - _before(counts)[row]


def _exons(locs: pa.Array) -> tuple:
    """Exons end to end: by row, bases and what is odd; by stretch in the order of its protein, all rows behind one another, its
    start there, bases and first place."""
    counts = _numbers(pc.list_value_length(locs))
    chrom, start, end, positive = locs.flatten().flatten()
    row, _ = _each(counts)
    first = np.minimum(_before(counts)[:-1], max(len(row) - 1, 0))  # of rows with any
    size = np.maximum(_numbers(pc.subtract(end.cast(pa.int64()), start.cast(pa.int64()))), 0)
    start, end, way = _numbers(start.cast(pa.int64())), _numbers(end.cast(pa.int64())), _numbers(positive, True)
    forward = np.where(counts > 0, way[first], True) if len(row) else np.ones(len(counts), bool)
    turned = positive.is_valid().to_numpy(zero_copy_only=False) & (way != forward[row])
    behind = _before(turned)
    used = np.flatnonzero(behind[1:] == behind[first[row]])
    mixed = np.bincount(row, turned, len(counts)) > 0
    name = _numbers(chrom.dictionary_encode().indices, -1)
    other = (name >= 0) & (name[first[row]] >= 0) & (name != name[first[row]]) & (size > 0)
    many = np.bincount(row[used], other[used], len(counts)) > 0
    # backwards on the negative strand
    left = np.bincount(row[used], minlength=len(counts))
    mine, at = _each(left)
    used = used[_before(left)[mine] + np.where(forward[mine], at, left[mine] - 1 - at)]
    used = used[size[used] > 0]
    stretches = _before(size[used])[:-1], size[used], np.where(forward[row[used]], start[used], end[used] - 1)
    bases = np.bincount(row[used], size[used], len(counts)).astype(np.int64)
    chroms = chrom.take(pa.array(first, mask=counts == 0))
    return counts == 0, chroms, np.where(forward, 1, -1), many, mixed, bases, stretches


@F.arrow_udf(_LOCATION)
def _located(locs: pa.Array, cigars: pa.Array, malformed: pa.Array, found_at: pa.Array, found_to: pa.Array) -> pa.Array:
    """What ``genome_location`` tells, for all rows of a batch at once."""
    rows = len(locs)
    none, chroms, step, many, mixed, bases, (seg_at, seg_n, seg_first) = _exons(locs)
    codons, base = bases // 3, _before(bases)[:-1]
    a, b, given = _numbers(found_at), _numbers(found_to), pc.and_(found_at.is_valid(), found_to.is_valid()).to_numpy(zero_copy_only=False)
    ended = found_to.is_valid().to_numpy(zero_copy_only=False)
    # runs of the CIGARs, or residues as their own positions
    parsed = _parsed(pc.if_else(malformed.is_null(), cigars, pa.scalar(None, cigars.type)), pa.nulls(rows, pa.int64()))
    soft_start, soft_end, length, runs = parsed.flatten()
    short = pc.if_else(pa.array(ended & (_numbers(length) < b)), _SHORT, pa.scalar(None, pa.string()))
    error = pc.coalesce(malformed, pc.if_else(pa.array(_numbers(soft_start) + _numbers(soft_end) > 0), _CLIPPED, short))
    error = pc.if_else(cigars.is_valid(), error, pa.scalar(None, pa.string()))
    missing, wrong = (x.to_numpy(zero_copy_only=False) for x in (cigars.is_null(), error.is_valid()))
    run_row, _ = _each(_numbers(pc.list_value_length(runs)))
    keep, alone = ~(missing | wrong)[run_row], np.flatnonzero((missing | wrong) & ended)
    zeros = np.zeros(len(alone), np.int64)
    at, n, ref = (np.concatenate([_numbers(own)[keep], other]) for own, other in zip(runs.flatten().flatten(), (zeros, b[alone], zeros), strict=True))
    run_row = np.concatenate([run_row[keep], alone])
    order = np.argsort(run_row, kind="stable")
    run_row, at, n, ref = run_row[order], at[order], n[order], ref[order]
    beyond = np.bincount(run_row, (ref >= 0) & (ref + n > codons[run_row]), rows) > 0
    # the runs within the match, as stretches of exons and gaps
    part = given[run_row] & ~none[run_row] & (at < b[run_row]) & (at + n > a[run_row])
    run_row, at, n, ref = run_row[part], at[part], n[part], ref[part]
    low = ref + np.maximum(a[run_row], at) - at
    high = low + np.minimum(b[run_row], at + n) - np.maximum(a[run_row], at)
    from_, to = base[run_row] + 3 * low, base[run_row] + 3 * np.minimum(high, codons[run_row])
    one = np.searchsorted(seg_at, from_, side="right") - 1
    met = np.where((ref >= 0) & (from_ < to), np.searchsorted(seg_at, to) - one, 0)
    run, k = _each(met + ((ref < 0) | (high > codons[run_row])))
    row, gap = run_row[run], k == met[run]
    first, size = np.full(len(row), -1), np.ones(len(row), np.int64)
    own, s = run[~gap], (one[run] + k)[~gap]
    start = np.maximum(from_[own], seg_at[s])
    first[~gap], size[~gap] = seg_first[s] + step[row[~gap]] * (start - seg_at[s]), np.minimum(to[own], seg_at[s] + seg_n[s]) - start
    last = first + step[row] * (size - 1)
    # those that go on from the one before are one with it
    same = (row[1:] == row[:-1]) & (((first[1:] < 0) & (first[:-1] < 0)) | ((first[1:] >= 0) & (first[:-1] >= 0) & (first[1:] == last[:-1] + step[row[1:]])))
    head, tail = np.concatenate([[True] * (len(row) > 0), ~same]).astype(bool), np.concatenate([~same, [True] * (len(row) > 0)]).astype(bool)
    row, first, last = row[head], first[head], last[tail]
    named = chroms.take(pa.array(row))
    there = (first < 0) | named.is_valid().to_numpy(zero_copy_only=False)
    row, first, last, named = row[there], first[there], last[there], named.filter(pa.array(there))
    words = pa.array(first).cast(pa.string()), pc.if_else(pa.array(first == last), "", pc.binary_join_element_wise("-", pa.array(last).cast(pa.string()), ""))
    shown = pc.if_else(pa.array(first < 0), "-1", pc.binary_join_element_wise(named.cast(pa.string()), ":", *words, ""))
    listed = lambda of, values: pa.ListArray.from_arrays(pa.array(_before(np.bincount(of, minlength=rows)).astype(np.int32)), values)
    location = pc.if_else(pa.array(none), pa.scalar(None, pa.string()), pc.binary_join(listed(row, shown), "|"))
    errors = error.dictionary_encode()
    marks = np.stack([many, mixed, bases % 3 != 0, missing, wrong, beyond], 1) & ~none[:, None]
    row, kind = np.nonzero(np.concatenate([marks, none[:, None]], 1))
    texts = pa.array([*_WARNINGS, *(f"Bad CIGAR: {x}" for x in errors.dictionary.to_pylist())], pa.string())
    kind = np.where(kind == 4, _numbers(errors.indices)[row] + len(_WARNINGS), kind)
    return pa.StructArray.from_arrays([location, listed(row, texts.take(pa.array(kind)))], ["location", "warnings"])


def genome_location(locs: Column, cigar: Column, found_at: Column, found_to: Column) -> Column:
    """struct(location, warnings) of the residues [found_at, found_to) of a protein.

    ``locs`` is array<struct<chrom, start, end, positive>>.  The exons are laid end to end (backwards on the negative
    strand), three bases to a residue; stretches that go on by one base are ``chr:first-last``, one base ``chr:base``,
    inserted residues and those beyond the exons ``-1``; parts are joined by ``|``.

    Warnings: no exons (the location is null); several chromosomes (the first one's name stands for all); both strands (exons
    from the first that turns are left out); no whole number of codons (the rest is left out); a CIGAR that is missing, or
    malformed, clipped or too short (residues are their own positions); a CIGAR beyond the exons.
    """
    cigar = _given(cigar)
    return _located(locs, cigar, cigar_error(cigar), found_at.cast("long"), found_to.cast("long"))

"""Roll-ups of proteins and variants, and the reports on peptides that were found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colspec import to_long
from ..functions.genome import differences, genome_location, near_differences


def protein_rollup(bed: DataFrame) -> DataFrame:
    """bed (ord, chrom, start, end, name, strand) -> (name, locs), the locations in the order of ord."""
    loc = F.struct("ord", "chrom", "start", "end", (F.col("strand") != "-").alias("positive"))
    rows = bed.groupBy("name").agg(F.array_sort(F.collect_list(loc)).alias("l"))
    return rows.select("name", F.transform("l", lambda x: F.struct(x["chrom"].alias("chrom"), x["start"].alias("start"), x["end"].alias("end"), x["positive"].alias("positive"))).alias("locs"))


def variant_rollup(rows: DataFrame) -> DataFrame:
    """rows (ord, name, ind, cigar, dif) -> (name, cigar, n_cigars, inds, difs).

    The CIGAR is the most frequent one, of several the first to occur.  Individuals keep the order of ord; differences
    are a sorted set; both stay empty where there are none.
    """
    votes = rows.groupBy("name", "cigar").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = votes.groupBy("name").agg(F.max_by("cigar", F.struct(F.col("n"), -F.col("first"))).alias("cigar"), F.count("*").alias("n_cigars"))
    lists = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", "ind"))).alias("l"), F.array_sort(F.collect_set("dif")).alias("difs"))
    return best.join(lists, "name").select("name", "cigar", "n_cigars", F.transform("l", lambda x: x["ind"]).alias("inds"), "difs")


def _cell(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _between(cells: Column, start: str, end: str) -> Column:
    """The cells between two marks; none if a mark is missing."""
    low, high = F.array_position(cells, start), F.array_position(cells, end)
    return F.when((low > 0) & (high > low), F.slice(cells, (low + 1).cast("int"), (high - low - 1).cast("int"))).otherwise(F.array().cast("array<string>"))


def protein_cells(rows: DataFrame) -> DataFrame:
    """(name, locs) -> (cells): the name, then chromosome, start, end and strand of each location between LOCS{ and }SCOL."""
    quad = lambda x: F.array(x["chrom"], x["start"].cast("string"), x["end"].cast("string"), F.when(x["positive"], "+").otherwise("-"))
    return rows.select(F.concat(F.array(F.col("name"), F.lit("LOCS{")), F.flatten(F.transform("locs", quad)), F.array(F.lit("}SCOL"))).alias("cells"))


def parse_protein_cells(table: DataFrame) -> DataFrame:
    """The inverse of ``protein_cells``; a strand is positive unless it is ``-``, cells short of a location are left out."""
    rows = table.select(F.get("cells", F.lit(0)).alias("name"), _between(F.col("cells"), "LOCS{", "}SCOL").alias("l"))
    part = lambda i, k: F.get("l", i * 4 + k)
    loc = lambda i: F.struct(part(i, 0).alias("chrom"), to_long(part(i, 1)).alias("start"), to_long(part(i, 2)).alias("end"), (part(i, 3) != "-").alias("positive"))
    n = F.floor(F.size("l") / 4).cast("int")
    return rows.select("name", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), loc)).otherwise(F.array().cast("array<struct<chrom:string,start:bigint,end:bigint,positive:boolean>>")).alias("locs"))


def variant_cells(rows: DataFrame) -> DataFrame:
    """(name, cigar, inds, difs) -> (cells): name and CIGAR, then individuals in INDS{ }SDNI and differences in DIFS{ }SFID."""
    marks = lambda start, c, end: [F.array(F.lit(start)), F.transform(c, _cell), F.array(F.lit(end))]
    return rows.select(F.concat(F.array(F.col("name"), _cell(F.col("cigar"))), *marks("INDS{", "inds", "}SDNI"), *marks("DIFS{", "difs", "}SFID")).alias("cells"))


def parse_variant_cells(table: DataFrame) -> DataFrame:
    """The inverse of ``variant_cells``; a missing CIGAR is ``???``, missing lists are empty."""
    c = F.col("cells")
    cigar = F.when((F.size(c) > 1) & ~F.get(c, F.lit(1)).isin("INDS{", "DIFS{"), F.get(c, F.lit(1))).otherwise("???")
    return table.select(F.get(c, F.lit(0)).alias("name"), cigar.alias("cigar"), _between(c, "INDS{", "}SDNI").alias("inds"), _between(c, "DIFS{", "}SFID").alias("difs"))


def protein_of(name: Column) -> Column:
    """A sequence's protein is its name up to the first underscore."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def with_proteins(found: DataFrame, proteins: DataFrame, variants: DataFrame) -> DataFrame:
    """found (..., name) with the columns of its protein and its variant, null where there is none.

    Whatever columns the two tables have are joined, but for ``n_cigars``: leave out lists that are not wanted, as rows that
    are sorted for a join fill the memory of its tasks.
    """
    p = proteins.withColumnRenamed("name", "protein")
    v = variants.withColumnRenamed("name", "_variant").drop("n_cigars")
    rows = found.withColumn("protein", protein_of(F.col("name"))).join(p, "protein", "left")
    return rows.join(v, rows["name"] == v["_variant"], "left").drop("_variant")


def limit_to_proteins(found: DataFrame, proteins: DataFrame) -> DataFrame:
    """The matches whose protein is in ``proteins`` (protein)."""
    return found.where(F.col("name").isNotNull()).join(proteins.select("protein").distinct(), protein_of(found["name"]) == F.col("protein"), "left_semi")


def ownership(found: DataFrame, key: str = "look_for", inds: str = "inds") -> DataFrame:
    """(key, owners, n_owners): the different individuals over all matches of a peptide."""
    rows = found.select(key, F.explode(inds).alias("ind")).distinct()
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("ind")).alias("owners"), F.count("*").alias("n_owners"))


def peptide_variants(found: DataFrame, key: str = "look_for", difs: str = "difs") -> DataFrame:
    """(key, variants): the different differences over all matches of a peptide, told apart by their text."""
    rows = found.select(key, F.explode(difs).alias("dif")).distinct()
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("dif")).alias("variants"))


def frequencies(peptides: DataFrame, found: DataFrame) -> DataFrame:
    """peptides (look_for, pattern) -> (look_for, pattern, n_owners, variants joined by |)."""
    rows = peptides.select("look_for", "pattern").join(ownership(found).select("look_for", "n_owners"), "look_for", "left").join(peptide_variants(found), "look_for", "left")
    return rows.select("look_for", "pattern", F.coalesce("n_owners", F.lit(0)).alias("n_owners"), F.coalesce(F.array_join("variants", "|"), F.lit("")).alias("variants"))


def peptide_report(peptides: DataFrame, found: DataFrame, identifiers: DataFrame, within: int = 0) -> DataFrame:
    """One row for each peptide and match, and one with found = false for each peptide without a match.

    ``found`` is the output of ``with_proteins`` on named matches with match_ind, ``identifiers`` (protein, transcript,
    gene).  Differences near the match are those within ``within`` residues of it.  A protein without a variant has no CIGAR,
    which is a warning; what is wrong with a CIGAR is one for the location and an error for the differences.
    """
    difs = F.flatten(F.transform(F.filter(F.coalesce("difs", F.array().cast("array<string>")), lambda d: d.isNotNull()), differences))
    near = near_differences(difs, F.col("cigar"), F.col("found_at"), F.col("found_to"), within)
    where = genome_location(F.col("locs"), F.col("cigar"), F.col("found_at"), F.col("found_to"))
    rows = found.select(
        "look_for", "match_ind", "name", "protein", "found_at", "found_to", "cigar", "inds", where.alias("where"), F.transform(near, lambda d: d["desc"]).alias("near"),
    )
    rows = rows.join(identifiers, "protein", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    report = peptides.select("look_for", "pattern").join(rows, "look_for", "left")
    return report.select(
        "look_for", "pattern", F.col("match_ind").isNotNull().alias("found"), "match_ind", blank(F.col("name")).alias("name"), blank(F.col("protein")).alias("protein"),
        blank(F.col("transcript")).alias("transcript"), blank(F.col("gene")).alias("gene"), F.col("found_at"), F.col("found_to"), blank(F.col("cigar")).alias("cigar"),
        blank(F.col("where.location")).alias("location"), blank(F.array_join("where.warnings", "|")).alias("warnings"), F.coalesce(F.size(F.array_distinct("inds")), F.lit(0)).cast("long").alias("n_owners"),
        blank(F.array_join(F.array_sort(F.array_distinct("inds")), "|")).alias("owners"), blank(F.array_join(F.array_sort("near"), "|")).alias("near_variants"),
    )

"""The peptide search from patterns to reports, as one plan whose steps can be taken one by one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import digest, matches, proteins, search


@dataclass
class PeptideSearch:
    matches: DataFrame  # match_ind, look_for, found_in, found_at, found_to
    named: DataFrame  # and name
    annotated: DataFrame  # and protein, locs, cigar, inds, difs
    report: DataFrame
    frequencies: DataFrame
    rejected_rules: list[str]


def search_peptides(
    patterns: DataFrame, sequences: DataFrame, protein_rows: DataFrame, variant_rows: DataFrame, identifiers: DataFrame, rules: str | None = None, within: int = 0, suffixes: DataFrame | None = None, head: int = 16
) -> PeptideSearch:
    """patterns (look_for, pattern), sequences (seq_ind, name, seq); the rest as in ``operators.proteins``.

    The search uses the suffix array if there is one; without rules every match is kept.  Only the order of the matches
    is computed at once, all else when a step's DataFrame is used.
    """
    found = search.find(sequences, patterns, suffixes, head)
    bad: list[str] = []
    if rules is not None:
        parsed, bad = digest.parse_rules(rules)
        found = digest.filter_matches(found, sequences, parsed)
    ordered = matches.sort_found(found)
    named = matches.names(ordered, sequences)
    annotated = proteins.with_proteins(named, protein_rows, variant_rows)
    report = proteins.peptide_report(patterns, annotated, identifiers, within)
    return PeptideSearch(ordered, named, annotated, report, proteins.frequencies(patterns, annotated), bad)

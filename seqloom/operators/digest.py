r"""Enzymatic digest rules on matches.

A rule is ``^? before | start - end | after (! or $)``, each part a row of character classes: ``.`` for any, ``\c`` for a
character, two hexadecimal digits for a byte, ``[...]`` for a set of these.  A match satisfies it if the characters
before it end in ``before``, it starts with ``start`` and ends with ``end``, and ``after`` follows it; ``^`` and ``$`` ask
for the ends of the sequence right there.  Rules become regular expressions over slices: no Python runs on the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matches import _checked, _or_raise, match_error

_HEX = "0123456789abcdefABCDEF"


@dataclass
class Rule:
    at_start: bool = False
    at_end: bool = False
    before: list[str] = field(default_factory=list)  # regular expressions of one character
    start: list[str] = field(default_factory=list)
    end: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)


def _escaped(c: str) -> str:
    return f"\\x{{{ord(c):x}}}"


def _one(text: str, i: int) -> tuple[str, int]:
    """The character at i, written as \\c or as two hexadecimal digits, and the place behind it."""
    if text[i] == "\\":
        if i + 1 >= len(text):
            raise ValueError("Backslash at the end of a rule.")
        return _escaped(text[i + 1]), i + 2
    if i + 1 < len(text) and text[i] in _HEX and text[i + 1] in _HEX:
        return _escaped(chr(int(text[i : i + 2], 16))), i + 2
    raise ValueError(f"Malformed character class at {text[i:]!r}.")


def parse_rule(line: str) -> Rule:
    text, rule = line.strip(), Rule()
    if text.startswith("^"):
        rule.at_start, text = True, text[1:]
    parts, order, i, closed = [rule.before, rule.start, rule.end, rule.after], "|-|", 0, False
    at = 0
    while i < len(text):
        c = text[i]
        if closed:
            if not c.isspace():
                raise ValueError("Characters after the end of a rule.")
            i += 1
        elif c.isspace():
            i += 1
        elif c in "|-":
            if at >= 3 or order[at] != c:
                raise ValueError(f"Misplaced {c} in a rule.")
            at, i = at + 1, i + 1
        elif c in "!$":
            if at != 3:
                raise ValueError("A rule ends too early.")
            rule.at_end, closed, i = c == "$", True, i + 1
        elif c == ".":
            parts[at].append(".")
            i += 1
        elif c == "[":
            found, i = [], i + 1
            while i < len(text) and text[i] != "]":
                one, i = _one(text, i)
                found.append(one)
            if i >= len(text) or not found:
                raise ValueError("Unclosed or empty set in a rule.")
            parts[at].append(f"[{''.join(found)}]")
            i += 1
        else:
            one, i = _one(text, i)
            parts[at].append(one)
    if not closed:
        raise ValueError("A rule must end in ! or $.")
    return rule


def parse_rules(text: str) -> tuple[list[Rule], list[str]]:
    """(rules, complaints): bad lines are reported and skipped."""
    rules, bad = [], []
    for line in text.splitlines():
        if line.strip():
            try:
                rules.append(parse_rule(line))
            except ValueError as e:
                bad.append(f"{line}: {e}")
    return rules, bad


def satisfies(rules: list[Rule], seq: Column, found_at: Column, found_to: Column, literal: bool = False) -> Column:
    """Whether the match [found_at, found_to) satisfies any rule.

    ``literal`` takes ``^`` and ``$`` to speak of the context that is cut to the longest of all rules.
    """
    at, to, n = found_at.cast("int"), found_to.cast("int"), F.length(seq)
    most_before = max((len(r.before) for r in rules), default=0)
    most_after = max((len(r.after) for r in rules), default=0)
    left = F.least(at, F.lit(most_before)) if literal else at
    right = F.least(n - to, F.lit(most_after)) if literal else n - to

    def is_(classes: list[str], start: Column) -> Column:
        k = len(classes)
        return seq.substr(start + 1, F.lit(k)).rlike(f"(?s)^{''.join(classes)}$") if k else F.lit(True)

    def one(r: Rule) -> Column:
        b, s, e, a = (len(x) for x in (r.before, r.start, r.end, r.after))
        edges = (left == b if r.at_start else left >= b) & (right == a if r.at_end else right >= a)
        fits = edges & (to - at >= max(s, e))
        return fits & is_(r.before, at - b) & is_(r.start, at) & is_(r.end, to - e) & is_(r.after, to)

    return reduce(lambda x, y: x | y, map(one, rules), F.lit(False))


def filter_matches(matches: DataFrame, seqs: DataFrame, rules: list[Rule], literal: bool = False) -> DataFrame:
    """The matches that satisfy a rule; matches outside their sequence are an error."""
    rows = _checked(matches, seqs, "seq")
    rows = rows.withColumn("seq", _or_raise(match_error(F.length("seq")), F.col("seq")))
    return rows.where(satisfies(rules, F.col("seq"), F.col("found_at"), F.col("found_to"), literal)).select(*matches.columns)

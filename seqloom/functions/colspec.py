"""Column specifications of ragged tables: ``3`` is column 3 as text, ``i3`` as an integer, ``f3`` as a double."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_KINDS = {"": "bytes", "i": "long", "f": "double"}


def parse(spec: str) -> tuple[str, int]:
    """(kind, index); a ValueError says what is wrong."""
    if not spec:
        raise ValueError("Empty column specification.")
    code, number = ("", spec) if spec[0].isdigit() or spec[0] == "-" else (spec[0], spec[1:])
    if code not in _KINDS:
        raise ValueError(f"Unknown type code {code}")
    if not re.fullmatch(r"-?[0-9]+", number):
        raise ValueError(f"Malformed column specification. {spec}")
    if int(number) < 0:
        raise ValueError(f"Negative column index. {spec}")
    return _KINDS[code], int(number)


def parse_all(specs: list[str]) -> list[tuple[str, int]]:
    if not specs:
        raise ValueError("Must specify a column.")
    return [parse(s) for s in specs]


def consistent(left: list[str], right: list[str]) -> None:
    a, b = parse_all(left), parse_all(right)
    if len(a) != len(b):
        raise ValueError("Specifications have different numbers of columns.")
    if [k for k, _ in a] != [k for k, _ in b]:
        raise ValueError("Mismatched specification types.")


def to_long(text: Column) -> Column:
    """Leading blanks, a sign and digits; anything else is 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))


def to_double(text: Column) -> Column:
    number = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def cell(cells: Column, index: int) -> Column:
    """Cell ``index``, an error if the row is too short."""
    return F.when(F.size(cells) > index, F.get(cells, F.lit(index))).otherwise(F.raise_error(F.lit("Table entry has too few columns.")).cast("string"))


def key(cells: Column, spec: str) -> Column:
    kind, index = parse(spec)
    value = cell(cells, index)
    return {"bytes": lambda: value, "long": lambda: to_long(value), "double": lambda: to_double(value)}[kind]()


def keys(cells: Column, specs: list[str], prefix: str = "key") -> list[Column]:
    parse_all(specs)
    return [key(cells, s).alias(f"{prefix}{i}") for i, s in enumerate(specs)]

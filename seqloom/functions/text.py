"""Scalar functions on text, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ends_with(text: Column, suffix: str) -> Column:
    return text.endswith(suffix)


def _set(chars: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in chars)


def span_until(text: Column, chars: str) -> Column:
    """Length of the longest start without any of ``chars``."""
    return F.length(F.regexp_extract(text, f"^[^{_set(chars)}]*", 0))


def span_while(text: Column, chars: str) -> Column:
    """Length of the longest start of only ``chars``."""
    return F.length(F.regexp_extract(text, f"^[{_set(chars)}]*", 0))


def find_first(text: Column, sub: Column) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return F.position(sub, text) - 1


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common start."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(places, lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)))
    return F.coalesce(F.get(differs, F.lit(0)) - 1, n)


def split_on(text: Column, chars: str) -> Column:
    return F.split(text, f"[{_set(chars)}]", -1)


def hex_nibble(c: Column) -> Column:
    """Value of one hexadecimal digit, -1 for anything else."""
    return F.when(c.rlike("^[0-9A-Fa-f]$"), F.conv(c, 16, 10).cast("int")).otherwise(-1)


def hex_byte(cc: Column) -> Column:
    return F.when(cc.rlike("^[0-9A-Fa-f]{2}$"), F.conv(cc, 16, 10).cast("int")).otherwise(-1)


def phred_to_log10(quality: Column) -> Column:
    """array<double> of log10 error probabilities of phred characters, none for an empty text."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33) / F.lit(-10.0))


def log10_to_phred(values: Column) -> Column:
    code = lambda p: F.greatest(F.lit(33), F.least(F.lit(126), (p * -10 + 33).cast("int")))
    return F.array_join(F.transform(values, lambda p: F.char(code(p))), "")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def head_hex(text: Column, n: int) -> Column:
    """Hexadecimal bytes of the first n characters, ``*`` for each that is missing, separated by blanks."""
    here = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i <= F.length(text), F.hex(F.encode(text.substr(i, F.lit(1)), "utf-8"))).otherwise("*"))
    return F.array_join(here, " ")


def _stirling(x: np.ndarray) -> np.ndarray:
    """ln gamma of positive numbers: those below 16 are moved up by the recurrence, then the asymptotic series holds."""
    up = np.maximum(np.ceil(16 - x), 0)
    factor = np.ones_like(x)
    for k in range(16):
        factor = np.where(k < up, factor * (x + k), factor)
    z = x + up
    # B(2k) / (2k (2k - 1)) of the Bernoulli numbers
    terms = sum(b / z**k for k, b in ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188)))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + terms - np.log(factor)


@F.pandas_udf(DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    """Natural logarithm of the absolute gamma function, infinite at the poles."""
    v = x.to_numpy(float)
    with np.errstate(all="ignore"):
        mirrored = math.log(math.pi) - np.log(np.abs(np.sin(math.pi * (v - np.round(v))))) - _stirling(np.where(v < 0.5, 1 - v, 1.0))
        out = np.where(v < 0.5, mirrored, _stirling(np.where(v < 0.5, 1.0, v)))
    out = np.where(((v <= 0) & (v == np.floor(v))) | np.isinf(v), np.inf, out)
    return pd.Series(np.where(np.isnan(v), np.nan, out)).where(x.notna(), None)


#: Kinds of packed numbers: their numpy type without the order of bytes, and Spark's type to unpack into.
PACKED = {"int16": ("i2", "smallint"), "int32": ("i4", "int"), "int64": ("i8", "bigint"), "float32": ("f4", "float"), "float64": ("f8", "double")}


def _packed_type(kind: str, big: bool) -> np.dtype:
    return np.dtype((">" if big else "<") + PACKED[kind][0])


def pack(value: Column, kind: str, big: bool = True) -> Column:
    """The bytes of numbers as a fixed-length kind, in big- or little-endian order; null stays null.

    Integers that the kind does not hold lose their upper bytes, as in a cast of Spark without ANSI mode.
    """
    to = _packed_type(kind, big)
    whole = to.kind == "i"

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        raw = x[known].to_numpy("i8" if whole else "f8").astype(to).tobytes()
        out = np.full(len(x), None, object)
        out[known] = [raw[i : i + to.itemsize] for i in range(0, len(raw), to.itemsize)]
        return pd.Series(out)

    if not whole:
        return run(value.cast("double"))
    # a null among longs would make pandas round them
    value = value.cast("long")
    return F.when(value.isNotNull(), run(F.coalesce(value, F.lit(0).cast("long"))))


def unpack(value: Column, kind: str, big: bool = True) -> Column:
    """Numbers of what ``pack`` gives; bytes of another length, and null, are null."""
    of, (_, spark_type) = _packed_type(kind, big), PACKED[kind]

    @F.pandas_udf(spark_type)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.frombuffer(b"".join(x), of).astype(of.newbyteorder("=")))

    fits = F.length(value) == of.itemsize
    return F.when(fits, run(F.when(fits, value).otherwise(F.lit(bytes(of.itemsize)))))

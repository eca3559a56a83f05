"""Fill-in-the-middle: a text becomes prefix, suffix and middle around three marks, and back.

A task decodes each text to its code points, gives every code point a class, and has a boundary wherever neighbouring
classes differ; two boundaries, chosen by rank, cut the text, and the pieces are encoded again in the order of the form:
``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain``
is the text.  Units are single code points (``char``: every one is a class of its own) or runs of letters, digits, blanks and
other signs (``word``).

What is drawn depends on nothing but the seed and doc_id: h1 to h4 are the first four groups of eight hexadecimal digits of
the SHA-256 of ``seed:doc_id``.  Of n units the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1), the middle
after the larger.  A text is plain if h3 % 100 is at least ``percent``, and spm if h4 % 100 is below ``spm_percent``.

Defined results: null is the empty text.  Empty texts and texts that hold a mark are plain, so that every output can be
taken apart.  A null id is drawn as the empty text.  Repeated rows each give a row, equal ones the same.  An empty table
gives an empty one.  Texts are whole at any length.  Columns of the names that are added are replaced; other columns,
whatever their names, are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .scratch import importable, quoted

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("form", "output", "n_units", "prefix_chars", "middle_chars")
UNITS = ("char", "word")
#: Bytes of output that leave a task at a time.
_FLUSH = 4 << 20


def _classes(codes: np.ndarray, unit: str) -> np.ndarray:
    """A class for every code point: its place, or 1 for letters, 2 for digits, 3 for blanks, 0 for the rest."""
    if unit == "char":
        return np.arange(len(codes))
    kinds, where = np.unique(codes, return_inverse=True)
    signs = map(chr, kinds.tolist())
    return np.array([1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 0 for c in signs], np.int64)[where]


def boundaries(codes: np.ndarray, unit: str = "char") -> np.ndarray:
    """0, the places between two units, and the length: one more than there are units."""
    if not len(codes):
        return np.zeros(1, np.int64)
    kinds = _classes(codes, unit)
    return np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(codes)]])


def rearranged(text: str, form: str, h1: int, h2: int, unit: str = "char") -> tuple[str, int, int | None, int | None]:
    """(output, units, code points of the prefix, of the middle)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = boundaries(codes, unit)
    n = len(ends) - 1
    if form == "plain":
        return text, n, None, None
    a, b = (int(ends[r]) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (codes[x:y].tobytes().decode("utf-32-le", "surrogatepass") for x, y in ((0, a), (a, b), (b, len(codes))))
    first = f"{PREFIX}{prefix}{SUFFIX}{suffix}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}"
    return f"{first}{MIDDLE}{middle}", n, a, b - a


def fill_in_middle(docs: DataFrame, seed: str = "1", percent: int = 90, spm_percent: int = 20, unit: str = "char") -> DataFrame:
    """All rows and columns of ``docs`` with form, output, n_units, and the code points of prefix and middle (null if plain)."""
    if unit not in UNITS:
        raise ValueError(f"The unit is one of {', '.join(UNITS)}.")
    importable(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    whole = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h[2] % 100 >= percent)
    form = F.when(whole, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*(quoted(c) for c in kept)).alias("row"), text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lo, size = [], 0, 0
            for i, (t, f, h1, h2) in enumerate(zip(*(batch.column(c) for c in range(1, 5)), strict=True)):
                out.append(rearranged(t.as_py(), f.as_py(), h1.as_py(), h2.as_py(), unit))
                size += len(out[-1][0])
                if size >= _FLUSH or i + 1 == batch.num_rows:
                    output, *numbers = zip(*out, strict=True)
                    part = [batch.column(c).slice(lo, i + 1 - lo) for c in (0, 2)]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(output, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], ["row", *ADDED])
                    out, lo, size = [], i + 1, 0

    fields = [StructField("row", rows.schema["row"].dataType), StructField("form", StringType()), StructField("output", StringType()), *(StructField(c, LongType()) for c in ADDED[2:])]
    made = rows.mapInArrow(run, StructType(fields))
    return made.select(*(F.col("row")[c].alias(c) for c in kept), *ADDED)


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from.  No piece holds a mark, so the marks that are there are the ones put in."""
    behind = lambda mark: F.get(F.split(output, mark, 2), F.lit(1))
    part = lambda mark, end: F.substring_index(behind(mark), end, 1)
    middle = behind(MIDDLE)
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

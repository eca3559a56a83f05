"""Near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors; a vector is described by its ``nearest`` most similar pivots in
order.  Inverted lists hold the vectors under each pair of their pivots of which one is among the ``front`` first, so two
vectors meet if they share such a pair; in a list the shared pivots are counted, pairs with ``min_shared`` or more are
candidates, and only these are verified by cosine in double precision.

The number of pivots follows the square root of the number of vectors up to ``max_pivots`` and ``PIVOT_BYTES`` for all
lengths of vectors together, a bound on what is broadcast; of ever more lengths the most frequent ``MOST_LENGTHS`` have
pivots.  A length that fits in a block, or has no pivots, is one list, in which all are compared.  Every vector is indexed.  Equal vectors are one class and take part once; lists with the same members are
merged; long lists are compared in square tiles of bounded size; a pair counts in the smallest list that both are in; a
tile returns at most one row per member.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do
vectors of different lengths.  A null ``vec_id`` is linked with nothing, its component is null and it is kept.  Rows with
equal ids are the same vector's: links are counted per row, and they share a component.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

#: Members of one block of a long list; a tile holds two blocks.
BLOCK = 1024
#: Bytes of the sample that pivots are drawn from, four times the pivots', and lengths of vectors that have some.
PIVOT_BYTES, MOST_LENGTHS = 128 << 20, 64


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, raw: the components as double bytes, null for vectors that cannot be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, raw = batch.column(1), []
            for v in col:
                x = None if not v.is_valid else v.values
                if x is None or len(x) == 0 or x.null_count:
                    raw.append(None)
                    continue
                x = np.asarray(x.to_numpy(zero_copy_only=False), np.float64) + 0.0  # -0.0 equals 0.0
                raw.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "raw"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, raw binary")


def choose_pivots(classes: DataFrame, max_pivots: int, apart: tuple[float, ...] = (0.7, 0.8, 0.9, 0.95)) -> dict[int, np.ndarray]:
    """Unit pivots for lengths of vectors: of a bounded sample by hash, those that are not close to one another.

    Pivots from one dense group would be the nearest of all its members in an order that is mere noise.  Where the
    vectors all lie close together, the cosines allowed between pivots rise in steps until there are enough.
    """
    out = {}
    sizes = classes.groupBy(F.octet_length("raw").alias("size")).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    sizes = sizes.orderBy(F.desc("n"), "size").limit(MOST_LENGTHS).collect()
    for size, n in sizes:
        m = min(max_pivots // len(sizes), PIVOT_BYTES // len(sizes) // (4 * size), max(32, 1 << round(math.log2(n) / 2)))
        if m < 2:
            continue
        rows = classes.where(F.octet_length("raw") == size).select("raw").orderBy(F.xxhash64("raw", F.lit("pivot")), "raw").limit(4 * m).collect()
        drawn = _unit([bytes(r.raw) for r in rows])
        taken = np.zeros((m, drawn.shape[1]))
        k = 0
        for most in apart:
            for x in drawn:
                if k < m and (k == 0 or (taken[:k] @ x).max() < most):
                    taken[k] = x
                    k += 1
        out[size] = taken[:k]
    return out


def _index(pivots: dict[int, np.ndarray], nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [bytes(x.as_py()) for x in batch.column(0)]
            order: list = [[-2, -1]] * len(raw)  # of a length without pivots all are alike: one list
            for size in {len(r) for r in raw} & set(pivots):
                rows = [i for i, r in enumerate(raw) if len(r) == size]
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    like = _unit([raw[i] for i in part]) @ pivots[size].T
                    more = [-1] if like.shape[1] < 2 else []
                    for i, o in zip(part, np.argsort(-like, axis=1, kind="stable")[:, :nearest].tolist(), strict=True):
                        order[i] = o + more
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order, pa.list_(pa.int32()))], ["raw", "cls", "pivots"])

    return run


def _tile(threshold: float, min_shared: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        here, bi, bj = (x.as_py() for x in key)
        table = table.sort_by("cls")
        cls, block, rows = table["cls"].to_numpy(), table["block"].to_numpy(), table["n"].to_numpy()
        x = _unit([bytes(r.as_py()) for r in table["raw"]])
        n = len(cls)

        def incidence(column: str, keep=lambda v: True) -> np.ndarray:
            lists = [[v for v in row if keep(v)] for row in table[column].to_pylist()]
            place = {v: i for i, v in enumerate({v for row in lists for v in row})}
            out = np.zeros((n, max(1, len(place))), np.float32)
            for i, row in enumerate(lists):
                out[i, [place[v] for v in row]] = 1
            return out

        pivots = incidence("pivots")
        ok = pivots @ pivots.T >= min_shared
        earlier = incidence("lists", lambda v: v < here)
        ok &= earlier @ earlier.T == 0  # a pair counts in the smallest of its lists
        np.fill_diagonal(ok, False)
        if bi != bj:
            ok &= block[:, None] != block[None, :]
        a, b = np.nonzero(ok)
        link = np.zeros((n, n), bool)
        for lo in range(0, len(a), 1 << 16):
            i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
            link[i, j] = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        links = link @ rows
        root = np.arange(n)
        while True:
            low = np.minimum(root, np.where(link, root[None, :], n).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(links > 0)
        return pa.table({"a": cls[some], "b": cls[root[some]], "links": links[some].astype(np.int64)})

    return run


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.95, nearest: int = 7, front: int = 4, min_shared: int = 2, max_pivots: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None
) -> DataFrame:
    """``id_col``, n_links, component_id, kept: one row per row of ``vectors``."""
    scratch = scratch or Scratch(vectors.sparkSession, "pivots")
    rows = scratch.keep(usable(vectors, id_col, vec_col), "vectors")
    good = rows.where("raw is not null and id is not null")
    # written once, so a number names a class
    classes = scratch.keep(good.groupBy("raw").agg(F.min("id").alias("low"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    pivots = choose_pivots(classes, max_pivots)
    order = scratch.keep(classes.select("raw", "cls").mapInArrow(_index(pivots, nearest), "raw binary, cls long, pivots array<int>"), "order")

    # inverted lists under pairs of near pivots, of vectors of one length: from each of the first on to all behind it
    p = F.col("pivots")
    behind = lambda x, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")))
    pairs = F.flatten(F.transform(F.slice(p, 1, front), behind))
    post = order.select("cls", F.octet_length("raw").alias("size"), F.explode(pairs).alias("pair")).select("cls", F.xxhash64("size", "pair.x", "pair.y").alias("list"))
    stats = post.groupBy("list").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("cls")).alias("h1"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("h2")).where("members > 1")
    stats = stats.groupBy("members", "h1", "h2").agg(F.min("list").alias("list"))
    placed = post.join(stats.select("list", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "list")
    placed = placed.groupBy("cls").agg(F.collect_list("list").alias("lists"), F.collect_list(F.struct("list", "blocks", F.pmod(F.xxhash64("cls", "list"), "blocks").cast("int").alias("block"))).alias("places"))
    members = order.join(placed, "cls").join(classes.select("cls", "n"), "cls")
    tiles = members.select("cls", "n", "raw", "pivots", "lists", F.explode("places").alias("p")).select(
        "cls", "n", "raw", "pivots", "lists", "p.list", "p.block", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)).alias("other")
    )
    tiles = tiles.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other")
    found = tiles.groupBy("list", "bi", "bj").applyInArrow(_tile(threshold, min_shared), "a long, b long, links long")
    found = scratch.keep(found, "links")

    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    # components over ids: a class goes by its smallest one
    low = classes.select("cls", "low")
    edges = found.where("a <> b").select("a", "b").distinct().join(low.toDF("a", "x"), "a").join(low.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    info = scratch.keep(classes.join(links, "cls", "left").select("raw", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "info")
    out = scratch.keep(rows.join(info, "raw", "left").select("id", F.when(F.col("id").isNotNull(), F.col("n_links")).alias("n_links"), F.when(F.col("id").isNotNull(), F.col("low")).alias("low")), "rows")
    # rows of one id with different vectors tie their classes
    ties = out.where("low <> id").select(F.col("id").alias("a"), F.col("low").alias("b"))
    comp = components(edges.unionAll(ties), scratch)
    out = out.join(comp, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )

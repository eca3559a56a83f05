"""Sequence graphs as edge tables: (graph_id, src, dst) between places of a graph's characters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged, with_rank

_NODE = ["graph_id", "node"]
#: Rounds of a search for components before chains are contracted.
PATIENCE = 12
#: Edges, with repeats, of graphs that are ordered many at once: they have 64 nodes at most, so a number holds what one reaches.
SMALL_EDGES = 32


def flatten(jumps: DataFrame) -> DataFrame:
    """Sorted distinct jumps of (graph_id, src, dst); a target that nothing leaves gets a jump to itself."""
    edges = jumps.select("graph_id", "src", "dst").distinct()
    ends = edges.select("graph_id", F.col("dst").alias("src")).distinct().join(edges.select("graph_id", "src").distinct(), ["graph_id", "src"], "left_anti")
    return edges.unionByName(ends.withColumn("dst", F.col("src")))


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(graph_id, node, distance) of all nodes within ``hops`` steps of the starts, either way along the edges."""
    both = edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("to")).unionAll(edges.select("graph_id", F.col("dst").alias("node"), F.col("src").alias("to"))).distinct()
    seen = starts.select("graph_id", "node").distinct().withColumn("distance", F.lit(0).cast("long"))
    edge = seen
    for hop in range(1, hops + 1):
        reached = edge.select("graph_id", "node").join(both, ["graph_id", "node"]).select("graph_id", F.col("to").alias("node")).distinct()
        edge = staged(reached.join(seen.select("graph_id", "node"), ["graph_id", "node"], "left_anti").withColumn("distance", F.lit(hop).cast("long")), "hop")
        seen = seen.unionByName(edge)
    return seen


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between kept nodes, with new_src and new_dst: the places in the order of the kept nodes of each graph."""
    # ranks over all graphs, less those of the graphs before: a big graph is no single task's
    at = staged(with_rank(nodes.select("graph_id", "node").distinct(), ["graph_id", "node"], "_rank"), "nodes")
    first = at.groupBy("graph_id").agg(F.min("_rank").alias("_first"))
    at = at.join(first, "graph_id").select("graph_id", "node", (F.col("_rank") - F.col("_first")).alias("new"))
    rows = edges.join(at.select("graph_id", F.col("node").alias("src"), F.col("new").alias("new_src")), ["graph_id", "src"])
    return rows.join(at.select("graph_id", F.col("node").alias("dst"), F.col("new").alias("new_dst")), ["graph_id", "dst"]).select("graph_id", "src", "dst", "new_src", "new_dst")


def topological_layers(edges: DataFrame) -> DataFrame:
    """(graph_id, node, layer): nodes without predecessors are layer 0 and go first; those on or behind cycles get -1.

    Loops are ignored.  A step (node, pred, n) says that the longest way from pred to node has n edges; pred is null for
    the start of all nodes without predecessors.  A pred with one step itself is replaced by the pred of that step, and of
    steps between the same nodes the longest stays.  So chains, trees and chains of bubbles take rounds by the logarithm of
    their depth, others at most one for each layer, and only nodes on or behind cycles never come down to the start alone.
    """
    nodes = edges.select("graph_id", F.col("src").alias("node")).unionAll(edges.select("graph_id", F.col("dst").alias("node"))).distinct()
    steps = edges.where("graph_id is not null and src <> dst").select("graph_id", F.col("dst").alias("node"), F.col("src").alias("pred"), F.lit(1).cast("long").alias("n")).distinct()
    starts = nodes.join(steps.select("graph_id", "node").distinct(), ["graph_id", "node"], "left_anti")
    steps = staged(steps.unionByName(starts.select("graph_id", "node", F.lit(None).cast(steps.schema["pred"].dataType).alias("pred"), F.lit(0).cast("long").alias("n"))), "layer")
    # a way of as many edges as a graph has nodes runs through a cycle: its step stays as it is
    most, moved = nodes.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0, True
    while moved:
        single = steps.groupBy("graph_id", "node").agg(F.count("*").alias("_k"), F.first("pred").alias("_pred"), F.first("n").alias("_n")).where("_k = 1")
        single = single.select("graph_id", F.col("node").alias("pred"), "_pred", "_n")
        open_ = f"pred is not null and n < {most}"
        after = steps.where(open_).join(single, ["graph_id", "pred"], "left")
        known = F.col("_n").isNotNull()
        after = after.select("graph_id", "node", F.when(known, F.col("_pred")).otherwise(F.col("pred")).alias("pred"), F.when(known, F.col("n") + F.col("_n")).otherwise(F.col("n")).alias("n"), known.alias("moved"))
        after = after.unionByName(steps.where(f"not ({open_})").select("graph_id", "node", "pred", "n", F.lit(False).alias("moved")))
        after = staged(after.groupBy("graph_id", "node", "pred").agg(F.max("n").alias("n"), F.max("moved").alias("moved")), "layer")
        moved = not after.where("moved").isEmpty()
        steps = after.drop("moved")
    only_start = (F.count("*") == 1) & (F.count("pred") == 0)
    return steps.groupBy("graph_id", "node").agg(F.when(only_start, F.max("n")).otherwise(F.lit(-1)).cast("long").alias("layer"))


def _contracted(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Links without the nodes inside chains, and the chosen (graph_id, node, pred, succ) of every round.

    A node with one link in and one out gives way to a link between its neighbours; of neighbours that could both go the one
    with the smaller draw goes.  A chain or ring loses a third of its nodes in each round.
    """
    taken: list[DataFrame] = []
    while True:
        ins = links.groupBy("graph_id", F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.first("src").alias("pred")).where("i = 1")
        outs = links.groupBy("graph_id", F.col("src").alias("node")).agg(F.count("*").alias("o"), F.first("dst").alias("succ")).where("o = 1")
        middle = staged(ins.join(outs, _NODE).select(*_NODE, "pred", "succ", F.struct(F.xxhash64("graph_id", "node", F.lit(len(taken))), "node").alias("draw")), "middle")
        if middle.isEmpty():
            return links, taken
        near = lambda end: middle.select("graph_id", F.col("node").alias(end), F.col("draw").alias(f"{end}_draw"))  # noqa: E731, B023
        least = lambda end: F.col(f"{end}_draw").isNull() | (F.col("draw") < F.col(f"{end}_draw"))
        chosen = middle.join(near("pred"), ["graph_id", "pred"], "left").join(near("succ"), ["graph_id", "succ"], "left").where(least("pred") & least("succ"))
        chosen = staged(chosen.select(*_NODE, "pred", "succ"), "chosen")
        gone = lambda end: chosen.select("graph_id", F.col("node").alias(end))  # noqa: E731, B023
        kept = links.join(gone("src"), ["graph_id", "src"], "left_anti").join(gone("dst"), ["graph_id", "dst"], "left_anti").select("graph_id", "src", "dst")
        links = staged(kept.unionByName(chosen.where("pred <> succ").select("graph_id", F.col("pred").alias("src"), F.col("succ").alias("dst"))).distinct(), "links")
        taken.append(chosen)


def _expanded(found: DataFrame, taken: list[DataFrame]) -> DataFrame:
    """Components of the nodes that gave way: their neighbours' if these share one, else their own."""
    for chosen in reversed(taken):
        of = lambda end: found.select("graph_id", F.col("node").alias(end), F.col("component").alias(f"{end}_component"))  # noqa: E731, B023
        same = F.when(F.col("pred_component") == F.col("succ_component"), F.col("pred_component")).otherwise(F.col("node"))
        more = chosen.join(of("pred"), ["graph_id", "pred"]).join(of("succ"), ["graph_id", "succ"]).select(*_NODE, same.alias("component"))
        found = staged(found.unionByName(more), "expanded")
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """(graph_id, node, component): nodes that reach each other share the smallest of their numbers.

    Nodes that are on no way between cycles are components of their own, which the layers tell.  Every other node takes the
    smallest number that reaches it and the smallest that it reaches; where both are one, that is its component.  The
    rest goes on by itself, without the edges between nodes of other pairs of numbers, until none is left.  A turn that
    takes more than ``PATIENCE`` rounds goes on without the nodes inside chains, so long cycles take rounds by the logarithm of
    their length; the rounds follow the longest shortest way within what is left of the parts that have cycles.
    """
    links = staged(edges.where("graph_id is not null and src <> dst").select("graph_id", "src", "dst").distinct(), "links")
    nodes = edges.select("graph_id", F.col("src").alias("node")).unionAll(edges.select("graph_id", F.col("dst").alias("node"))).where("graph_id is not null and node is not null").distinct()
    nodes = staged(nodes, "nodes")
    behind = topological_layers(links).where("layer < 0").select(*_NODE)
    before = topological_layers(links.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).where("layer < 0").select(*_NODE)
    rest = staged(behind.join(before, _NODE, "left_semi"), "cyclic")
    out = [nodes.join(rest, _NODE, "left_anti").withColumn("component", F.col("node"))]
    rest, taken = rest.withColumns({"f": F.lit(0).cast("long"), "b": F.lit(0).cast("long")}), []
    start = lambda nodes: nodes.select(*_NODE, F.col("node").alias("f"), F.col("node").alias("b"), F.lit(True).alias("moved"))
    while not rest.isEmpty():
        end = lambda name: rest.select("graph_id", F.col("node").alias(name), "f", "b")  # noqa: E731, B023
        links = staged(links.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst", "f", "b"]).select("graph_id", "src", "dst"), "links")
        rest, moved, rounds = start(rest), True, 0
        while moved:
            if rounds == PATIENCE:  # long ways: without the nodes inside chains they are short
                links, chosen = _contracted(links)
                for nodes_gone in chosen:
                    rest = rest.join(nodes_gone.select(*_NODE), _NODE, "left_anti")
                rest, taken = staged(start(rest), "left"), taken + chosen
            rounds += 1
            news = rest.where("moved")
            on = links.join(news.select("graph_id", F.col("node").alias("src"), "f"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node"), F.col("f").alias("new_f"), F.lit(None).cast("long").alias("new_b"))
            back = links.join(news.select("graph_id", F.col("node").alias("dst"), "b"), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node"), F.lit(None).cast("long").alias("new_f"), F.col("b").alias("new_b"))
            low = on.unionAll(back).groupBy(*_NODE).agg(F.min("new_f").alias("new_f"), F.min("new_b").alias("new_b"))
            lower = F.coalesce(F.col("new_f") < F.col("f"), F.lit(False)) | F.coalesce(F.col("new_b") < F.col("b"), F.lit(False))
            rest = staged(rest.join(low, _NODE, "left").select(*_NODE, F.least("f", "new_f").alias("f"), F.least("b", "new_b").alias("b"), lower.alias("moved")), "reach")
            moved = not rest.where("moved").isEmpty()
        out.append(rest.where("f = b").select(*_NODE, F.col("f").alias("component")))
        rest = rest.where("f <> b").drop("moved")
    found = _expanded(reduce(DataFrame.unionByName, out), taken)
    least = found.groupBy("graph_id", "component").agg(F.min("node").alias("least"))
    return found.join(least, ["graph_id", "component"]).select(*_NODE, F.col("least").alias("component"))


def _small_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(graph_id, node, component, layer) of (graph_id, edges), all graphs of a batch at once."""
    for batch in batches:
        edges = batch.column(1)
        graph = np.repeat(np.arange(len(edges)), edges.value_lengths().to_numpy(zero_copy_only=False))
        src, dst = (c.to_numpy(zero_copy_only=False) if not c.null_count else c.to_pandas(integer_object_nulls=True).to_numpy() for c in edges.flatten().flatten())
        there = [np.array([x is not None for x in c]) if c.dtype == object else np.ones(len(c), bool) for c in (src, dst)]
        owner = np.concatenate([graph[there[0]], graph[there[1]]])
        value = np.concatenate([src[there[0]].astype(np.int64), dst[there[1]].astype(np.int64)])
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        number = np.empty(len(owner), np.int64)
        number[order] = np.cumsum(new) - 1
        owner, value = owner[new], value[new]  # the nodes, by graph and number
        first = np.searchsorted(owner, owner)
        own, most = np.arange(len(owner)) - first, int((np.arange(len(owner)) - first).max(initial=-1)) + 1
        both = there[0] & there[1]
        a, b = number[: there[0].sum()][both[there[0]]], number[there[0].sum() :][both[there[1]]]

        one, holds = np.uint64(1), lambda bits, k: bits >> k.astype(np.uint64) & np.uint64(1) == 1
        reach = one << own.astype(np.uint64)
        np.bitwise_or.at(reach, a, one << own[b].astype(np.uint64))
        component = np.arange(len(owner))
        last = len(owner) - 1
        for k in range(most):  # ways through each graph's node k
            through = np.minimum(first + k, last)
            some = (owner[through] == owner) & holds(reach, np.full(len(owner), k))
            reach[some] |= reach[through[some]]
        for k in reversed(range(most)):  # the smallest node that reaches and is reached
            through = np.minimum(first + k, last)
            same = (owner[through] == owner) & holds(reach, np.full(len(owner), k)) & holds(reach[through], own)
            component[same] = through[same]
        layer = np.zeros(len(owner), np.int64)
        a, b = component[a], component[b]
        a, b = a[a != b], b[a != b]
        while (late := layer[b] <= layer[a]).any():
            np.maximum.at(layer, b[late], layer[a[late]] + 1)
        columns = [batch.column(0).take(pa.array(owner)), pa.array(value), pa.array(value[component]), pa.array(layer[component])]
        yield pa.RecordBatch.from_arrays(columns, ["graph_id", "node", "component", "layer"])


def topological_order(edges: DataFrame) -> DataFrame:
    """(graph_id, node, component, layer): every edge between components goes to a higher layer; a cycle's nodes share one.

    Graphs of at most ``SMALL_EDGES`` edges are dealt to tasks and ordered there, a batch of graphs in one go; larger ones
    take part in rounds over all of their edges.
    """
    edges = edges.where("graph_id is not null").select("graph_id", "src", "dst")
    large = staged(edges.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_EDGES).select("graph_id"), "large")
    each = edges.join(large, "graph_id", "left_anti").groupBy("graph_id").agg(F.collect_list(F.struct(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("edges"))
    kind = {c: edges.schema[c].dataType.simpleString() for c in ("graph_id", "src")}
    small = each.mapInArrow(_small_orders, f"graph_id {kind['graph_id']}, node long, component long, layer long")
    small = small.select("graph_id", *(F.col(c).cast(kind["src"]).alias(c) for c in ("node", "component")), "layer")
    return small if large.isEmpty() else small.unionByName(_order_in_rounds(edges.join(large, "graph_id", "left_semi")))


def _order_in_rounds(edges: DataFrame) -> DataFrame:
    found = staged(strong_components(edges), "components")
    at = lambda end: found.select("graph_id", F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    between = edges.join(at("src"), ["graph_id", "src"]).join(at("dst"), ["graph_id", "dst"]).where("c_src <> c_dst").select("graph_id", F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct()
    layers = topological_layers(staged(between, "between")).withColumnRenamed("node", "component")
    return found.join(layers, ["graph_id", "component"], "left").select(*_NODE, "component", F.coalesce("layer", F.lit(0)).cast("long").alias("layer"))

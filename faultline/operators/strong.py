"""Strongly connected components of many directed graphs in one pass: edges(graph, src, dst).

Each round makes the graphs smaller in three ways, none of which changes what reaches what among the rest:
- nodes without an edge in or without one out are components of their own;
- a node with a single edge out is merged into the node that this leads to (along chains of such nodes at once, by doubling), likewise
  with single edges in; a ring of such nodes is a component;
- each node learns the first node, in an order of hashes, that reaches it, and the first that it reaches. Where the two are one,
  its component is found; edges between nodes that differ in either lie in no component and go.

Merged nodes are given back in reverse order: one belongs to the component of the node it was merged into if it, or a
node merged through it, has an edge from that component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .searches import together

_G = "graph"


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame], DataFrame]:
    """Nodes with one edge out merged along it: edges left, components found (rings, and what leads into them), jumps (graph, node, next) and merged nodes (graph, node, root)."""
    single = edges.groupBy(_G, F.col("src").alias("node")).agg(F.min("dst").alias("next"), F.count(F.lit(1)).alias("n")).where("n = 1")
    jump = stored(single.select(_G, "node", "next", F.least("node", "next").alias("low")))
    jumps, size = [jump], jump.groupBy(_G).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while 1 << (len(jumps) - 1) <= size:
        far = jumps[-1].select(_G, F.col("node").alias("next"), F.col("next").alias("beyond"), F.col("low").alias("far_low"))
        jumps.append(stored(jumps[-1].join(far, [_G, "next"], "left").select(_G, "node", F.coalesce("beyond", "next").alias("next"), F.coalesce(F.least("low", "far_low"), "low").alias("low"))))
    # after as many steps as there are such nodes, who still stands on one goes round a ring
    last = jumps[-1]
    on_one = last.join(last.select(_G, F.col("node").alias("next"), F.lit(True).alias("ring")), [_G, "next"], "left")
    on_one = stored(on_one.select(_G, "node", "next", "low", F.coalesce("ring", F.lit(False)).alias("ring")))
    rings = stored(on_one.where("ring").select(_G, F.col("next").alias("node")).distinct())
    found = on_one.where("ring").join(rings.withColumn("on", F.lit(True)), [_G, "node"], "left").select(_G, "node", F.when(F.col("on"), F.col("low")).otherwise(F.col("node")).alias("component"))
    merged = stored(on_one.where("not ring").select(_G, "node", F.col("next").alias("root")))
    gone = on_one.where("ring").select(_G, "node")
    left = edges.join(gone.withColumnRenamed("node", "src"), [_G, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [_G, "dst"], "left_anti")
    left = left.join(merged.select(_G, F.col("node").alias("src")), [_G, "src"], "left_anti")
    left = left.join(merged.select(_G, F.col("node").alias("dst"), "root"), [_G, "dst"], "left").select(_G, "src", F.coalesce("root", "dst").alias("dst")).where("src <> dst").distinct()
    return stored(left), stored(found), jumps, merged


def _returned(known: DataFrame, edges: DataFrame, jumps: list[DataFrame], merged: DataFrame) -> DataFrame:
    """known(graph, node, component) with the merged nodes; edges: those before they were merged."""
    of_root = merged.join(known.select(_G, F.col("node").alias("root"), "component"), [_G, "root"], "left").withColumn("component", F.coalesce("component", "root"))
    of_root = stored(of_root.select(_G, "node", "component"))
    entered = edges.select(_G, "src", F.col("dst").alias("node")).join(of_root, [_G, "node"])
    direct = entered.join(known.select(_G, F.col("node").alias("src"), F.col("component").alias("from")), [_G, "src"], "left").where(F.coalesce("from", "src") == F.col("component"))
    marked = stored(direct.select(_G, "node").distinct())
    for jump in jumps:
        ahead = marked.join(jump.select(_G, "node", "next"), [_G, "node"]).select(_G, F.col("next").alias("node")).join(merged.select(_G, "node"), [_G, "node"], "left_semi")
        marked = stored(marked.unionByName(ahead).distinct())
    inside = of_root.join(marked.withColumn("hit", F.lit(True)), [_G, "node"], "left")
    return inside.select(_G, "node", F.when(F.col("hit"), F.col("component")).otherwise(F.col("node")).alias("component"))


def _first(edges: DataFrame, turn: int) -> DataFrame:
    """graph, node, first: the first node, in the turn's order, that reaches each node, itself included."""
    # a node's key sorts by a hash, then by its name
    key = F.concat(F.lpad(F.hex(F.xxhash64(F.lit(turn), "node")), 16, "0"), "node")
    nodes = edges.select(_G, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("key", key)
    labels = stored(nodes.select(_G, "node", "key", F.col("key").alias("first"), F.lit(True).alias("moved")))
    while not labels.where("moved").isEmpty():
        near = edges.join(labels.select(_G, F.col("node").alias("src"), "first"), [_G, "src"]).groupBy(_G, F.col("dst").alias("node")).agg(F.min("first").alias("near"))
        lower = labels.join(near, [_G, "node"], "left").select(_G, "node", "key", F.col("first").alias("old"), F.least("first", "near").alias("first"))
        # who reaches the one that reaches it reaches it too
        top = labels.select(_G, F.col("key").alias("first"), F.col("first").alias("top"))
        lower = lower.join(top, [_G, "first"], "left").select(_G, "node", "key", "old", F.least("first", "top").alias("first"))
        labels = stored(lower.select(_G, "node", "key", "first", (F.col("first") != F.col("old")).alias("moved")))
    return labels.select(_G, "node", F.substring("first", 17, 1 << 30).alias("first"))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(_G, F.col("dst").alias("src"), F.col("src").alias("dst"))


def strong_components(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """graph, node, component: each node of the edges with the first node by name that it reaches and that reaches it. Edges of null ends are ignored."""
    whole = stored(edges.select(F.col(graph).alias(_G), "src", "dst").where("src is not null and dst is not null").distinct())
    left = stored(whole.where("src <> dst"))
    found: list[DataFrame] = []
    merges: list[tuple[DataFrame, list[DataFrame], DataFrame]] = []
    turn = 0
    while not left.isEmpty():
        for _ in range(2):
            both = left.join(left.select(_G, F.col("dst").alias("src")).distinct(), [_G, "src"], "left_semi").join(left.select(_G, F.col("src").alias("dst")).distinct(), [_G, "dst"], "left_semi")
            left = stored(both.select(_G, "src", "dst"))
        for way in (lambda e: e, _turned):
            before = stored(way(left))
            after, rings, jumps, merged = _contracted(before)
            found.append(rings)
            merges.append((before, jumps, merged))
            left = stored(way(after))
        if left.isEmpty():
            break
        turn += 1
        ends = stored(_first(left, turn).join(_first(_turned(left), turn).withColumnRenamed("first", "last"), [_G, "node"]))
        found.append(stored(ends.where("first = last").select(_G, "node", F.col("first").alias("component"))))
        kept = stored(ends.where("first <> last").select(_G, "node", F.xxhash64("first", "last").alias("box")))
        side = lambda c: kept.select(_G, F.col("node").alias(c), F.col("box").alias(f"{c}_box"))  # noqa: E731, B023
        left = stored(left.join(side("src"), [_G, "src"]).join(side("dst"), [_G, "dst"]).where("src_box = dst_box").select(_G, "src", "dst"))
    schema = whole.select(_G, F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    known = stored(together([schema, *found]))
    for before, jumps, merged in reversed(merges):
        known = stored(known.unionByName(_returned(known, before, jumps, merged)))
    nodes = whole.select(_G, F.explode(F.array("src", "dst")).alias("node")).distinct()
    named = nodes.join(known, [_G, "node"], "left").select(_G, "node", F.coalesce("component", "node").alias("c"))
    lows = named.groupBy(_G, "c").agg(F.min("node").alias("component"))
    out = stored(named).join(stored(lows), [_G, "c"]).select(F.col(_G).alias(graph), "node", "component")
    return out


def cyclic_graphs(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """graph, cyclic: is each graph no DAG? It has a component of two nodes or more, or an edge from a node to itself."""
    loops = edges.groupBy(F.col(graph).alias(_G)).agg(F.coalesce(F.bool_or(F.col("src") == F.col("dst")), F.lit(False)).alias("loop"))
    large = strong_components(edges, graph).where("node <> component").select(F.col(graph).alias(_G)).distinct().withColumn("ring", F.lit(True))
    return loops.join(large, _G, "left").select(F.col(_G).alias(graph), (F.col("loop") | F.coalesce("ring", F.lit(False))).alias("cyclic"))

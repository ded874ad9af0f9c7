"""How central nodes are, level by level: path counts are pushed forward and shares summed backward, as joins over (graph, source, node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .graph import degrees
from .searches import levels, together

#: Sources that stand for all where a caller asks for samples.
SAMPLED_SOURCES = 100


def betweenness(edges: DataFrame, graph: str = "graph", exact: int | None = None, samples: int = SAMPLED_SOURCES) -> DataFrame:
    """graph, node, betweenness: the share of shortest paths that pass through each node, over (n - 1)(n - 2); 6 decimals.

    All nodes of a graph are sources, whatever its size. With `exact`, of a graph of more nodes only the `samples` first in an
    order of hashes are, and their sum counts n / samples times. A row is a node that a source reaches, and nodes without
    outgoing edges are not searched from, as they reach none; no graph lies in one task.
    """
    e = stored(edges.select(F.col(graph).alias("graph"), "src", "dst").where("src <> dst").distinct())
    nodes = stored(edges.select(F.col(graph).alias("graph"), F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct())
    sizes = stored(nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n")))
    sources = nodes
    if exact is not None:
        order = Window.partitionBy("graph").orderBy(F.xxhash64("node"), "node")
        chosen = nodes.join(sizes.where(F.col("n") > exact), "graph").withColumn("k", F.row_number().over(order)).where(F.col("k") <= samples)
        sources = nodes.join(sizes.where(F.col("n") <= exact), "graph").select("graph", "node").unionByName(chosen.select("graph", "node"))
    sources = sources.join(e.select("graph", F.col("src").alias("node")).distinct(), ["graph", "node"], "left_semi")
    start = sources.select("graph", F.col("node").alias("source"), "node", F.lit(1.0).alias("ways"))
    keys = ["graph", "source", "node"]

    def step(last: DataFrame, _: int) -> DataFrame:
        return last.withColumnRenamed("node", "src").join(e, ["graph", "src"]).groupBy("graph", "source", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))

    reached = levels(start, keys, step)
    sums, owed = [], reached[-1].withColumn("owed", F.lit(0.0))
    for level in reached[-2::-1]:
        sums.append(owed.groupBy("graph", "node").agg(F.sum("owed").alias("owed")))
        far = owed.select("graph", "source", F.col("node").alias("dst"), F.col("ways").alias("far_ways"), "owed")
        share = F.sum(F.col("ways") / F.col("far_ways") * (1 + F.col("owed")))
        back = level.withColumnRenamed("node", "src").join(e, ["graph", "src"]).join(far, ["graph", "source", "dst"]).groupBy("graph", "source", F.col("src").alias("node")).agg(share.alias("owed"))
        owed = stored(level.join(back, keys, "left").select(*keys, "ways", F.coalesce("owed", F.lit(0.0)).alias("owed")))
    total = together(sums).groupBy("graph", "node").agg(F.sum("owed").alias("owed")) if sums else nodes.select("graph", "node", F.lit(0.0).alias("owed"))
    n = F.col("n").cast("double")
    scale = F.when(n > 2, 1 / ((n - 1) * (n - 2))).otherwise(1.0)
    if exact is not None:
        scale = scale * F.when(n > exact, n / F.least(n, F.lit(float(samples)))).otherwise(1.0)
    out = nodes.join(total, ["graph", "node"], "left").join(sizes, "graph")
    return out.select(F.col("graph").alias(graph), "node", F.round(F.coalesce("owed", F.lit(0.0)) * scale, 6).alias("betweenness"))


def entry_depths(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """graph, node, depth: the least number of edges from any of the nodes without incoming edges, for nodes that one reaches."""
    e = stored(edges.select(F.col(graph).alias("graph"), "src", "dst").distinct())
    roots = e.select("graph", F.col("src").alias("node")).distinct().join(e.select("graph", F.col("dst").alias("node")).distinct(), ["graph", "node"], "left_anti")
    step = lambda last, k: last.withColumnRenamed("node", "src").join(e, ["graph", "src"]).select("graph", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(k))
    return together(levels(roots.select("graph", "node", F.lit(0).alias("depth")), ["graph", "node"], step)).withColumnRenamed("graph", graph)


def root_difficulty(roots: DataFrame, edges: DataFrame, chain_length: Column, graph: str = "graph") -> DataFrame:
    """roots(graph, node, ...) with in_degree, out_degree, depth and betweenness.

    The depth is that of entry_depths, and the length of the root's chain where no entry reaches it. A root outside its graph has
    no degrees and no betweenness. Graphs without a root are not searched, as no graph tells of another.
    """
    keys = [graph, "node"]
    pairs = stored(edges.select(graph, "src", "dst").join(roots.select(graph).distinct(), graph, "left_semi").distinct())
    tagged = pairs.select(F.struct(graph, F.col("src").alias("node")).alias("src"), F.struct(graph, F.col("dst").alias("node")).alias("dst"))
    d = degrees(tagged).select(f"node.{graph}", "node.node", "in_degree", "out_degree")
    found = roots.join(d, keys, "left").join(entry_depths(pairs, graph), keys, "left").join(betweenness(pairs, graph), keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select(*roots.columns, zero("in_degree"), zero("out_degree"), F.coalesce("depth", chain_length).cast("int").alias("depth"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))

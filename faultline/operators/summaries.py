"""Summaries of runs, texts, localizations and graphs: counts and means, each in one pass, sums in decimals so that no order of adding shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as graphs
from . import strong

#: The kinds of a run that are counted by name; every other status is an error.
NAMED = ("valid", "invalid", "missing_image", "timeout")


def mean(x: Column, n: Column | None = None) -> Column:
    """The mean of the values that are there, or their sum over n rows; 0 without any. Exact to ten decimals."""
    total = F.sum(x.cast("decimal(28,10)")).cast("double")
    return F.coalesce(F.try_divide(total, F.count(x) if n is None else n), F.lit(0.0))


def run_totals(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, total, valid, invalid, missing_image, timeout, error, valid_bugs, success_rate (as text) of runs: status, is_valid.

    An unknown status and none at all are errors; the rate counts valid defects, not valid statuses.
    """
    named = [F.count_if(F.col("status") == s).alias(s) for s in NAMED]
    out = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *named, F.count_if(~F.coalesce(F.col("status").isin(*NAMED), F.lit(False))).alias("error"), F.count_if("is_valid").alias("valid_bugs"))
    return out.withColumn("success_rate", F.when(F.col("total") > 0, F.format_string("%.1f%%", 100.0 * F.col("valid_bugs") / F.col("total"))).otherwise("0%"))


def compared_groups(rows: DataFrame, flag: str, metrics: list[str], notable: float = 0.02) -> DataFrame:
    """metric, mean, mean_true, mean_false, delta, notable: means over all and over both groups of a flag, and whether they differ by more than `notable`. A null flag is in neither group."""
    pairs = ", ".join(f"'{m}', cast({m} AS double)" for m in metrics)
    long = rows.select(flag, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, v)"))
    v, f = F.col("v"), F.col(flag)
    out = long.groupBy("metric").agg(mean(v).alias("mean"), mean(F.when(f, v)).alias("mean_true"), mean(F.when(~f, v)).alias("mean_false"))
    delta = F.col("mean_true") - F.col("mean_false")
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "mean_true", "mean_false")], F.round(delta, 6).alias("delta"), (F.abs(delta) > notable).alias("notable"))


def grouped_means(rows: DataFrame, by: list[str], metrics: list[str], flag: str | None = None, absent_is_zero: tuple[str, ...] = ()) -> DataFrame:
    """by, n, the mean of each metric, and with a flag the share of rows that have it in per cent (flag_pct).

    A null metric is left out of its mean, but counts as 0 if it is one of absent_is_zero.
    """
    n = F.count(F.lit(1))
    means = [F.round(mean(F.col(m), n if m in absent_is_zero else None), 6).alias(m) for m in metrics]
    share = [] if flag is None else [F.round(100.0 * F.count_if(F.coalesce(flag, F.lit(False))) / n, 4).alias(f"{flag}_pct")]
    return rows.groupBy(*by).agg(n.alias("n"), *means, *share)


def found_share(found: Column, true: Column) -> Column:
    """The share of true entries among the found ones; 0 without true ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(true, found)).cast("double"), F.size(F.array_distinct(true))), F.lit(0.0))


def compared_methods(rows: DataFrame, methods: list[str]) -> DataFrame:
    """method, n, file_coverage, entity_overlap: what each method found, on average.

    rows: true_files, true_entities and, for each method m, m_files and m_entities (arrays).
    """
    each = F.array(*[F.struct(F.lit(m).alias("method"), found_share(F.col(f"{m}_files"), F.col("true_files")).alias("file_coverage"), found_share(F.col(f"{m}_entities"), F.col("true_entities")).alias("entity_overlap")) for m in methods])
    return grouped_means(rows.select(F.explode(each).alias("m")).select("m.*"), ["method"], ["file_coverage", "entity_overlap"])


def located_outside(rows: DataFrame, default_repo: str) -> DataFrame:
    """One row over the instances of other repositories than the default one: n, with_files, mean_files, mean_functions, covered.

    rows: repo, found_files, functions, true_files (arrays). An instance is covered if any true file was found; a null repository is no default.
    """
    other = rows.where(~F.col("repo").eqNullSafe(default_repo))
    files = F.size("found_files")
    n = F.count(F.lit(1))
    covered = F.count_if(F.arrays_overlap("found_files", "true_files"))
    return other.agg(n.alias("n"), F.count_if(files > 0).alias("with_files"), F.round(mean(files, n), 6).alias("mean_files"), F.round(mean(F.size("functions"), n), 6).alias("mean_functions"), covered.alias("covered"))


def graph_profiles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a graph: sizes, density, is_dag, weak components, degrees, leaves and their tokens, functions and their length.

    nodes: graph, node, type, code, each node once; edges: graph, src, dst, each pair once, between nodes of the list. All graphs are
    worked on together. A token of code is a word or a sign. Nodes without edges are components and leaves.
    """
    name = lambda c: F.to_json(F.struct(F.col("graph").alias("g"), F.col(c).alias("n")))
    ends = edges.select(F.explode(F.array(F.struct("graph", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct("graph", F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    degree = ends.groupBy("graph", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    code = F.coalesce("code", F.lit(""))
    tokens = F.regexp_count(code, F.lit(r"[\w]+|[^\w\s]"))
    seen = nodes.select("graph", "node", "type", tokens.alias("tokens"), F.length(code).alias("chars")).join(degree, ["graph", "node"], "left")
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    leaf, function = o == 0, F.col("type") == "function"
    n = F.count(F.lit(1))
    sizes = seen.groupBy("graph").agg(n.alias("n_nodes"), F.sum(o).alias("n_edges"), F.max(i).alias("max_in"), F.max(o).alias("max_out"), F.count_if(leaf).alias("n_leaves"), F.sum(F.when(leaf, F.col("tokens")).otherwise(0)).alias("leaf_tokens"), F.count_if(function).alias("n_functions"), F.sum(F.when(function, F.col("chars")).otherwise(0)).alias("function_chars"), F.count_if(F.col("i").isNull()).alias("alone"))
    joined = graphs.weak_components(edges.select(name("src").alias("src"), name("dst").alias("dst")))
    groups = joined.where("node = component").select(F.from_json("component", edges.select(F.col("graph").alias("g")).schema)["g"].alias("graph")).groupBy("graph").agg(F.count(F.lit(1)).alias("parts"))
    rings = strong.cyclic_graphs(edges)
    per = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 6)
    out = sizes.join(groups, "graph", "left").join(rings, "graph", "left").withColumn("pairs", F.col("n_nodes") * (F.col("n_nodes") - 1))
    return out.select("graph", "n_nodes", "n_edges", per("n_edges", "pairs").alias("density"), (~F.coalesce("cyclic", F.lit(False))).alias("is_dag"), (F.coalesce("parts", F.lit(0)) + F.col("alone")).alias("n_components"), per("n_edges", "n_nodes").alias("mean_degree"), "max_in", "max_out", "n_leaves", "leaf_tokens", per("leaf_tokens", "n_leaves").alias("mean_leaf_tokens"), "n_functions", per("function_chars", "n_functions").alias("mean_function_chars"))


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over many graphs: graphs, nodes, edges, and their means a graph. nodes and edges as of graph_profiles; a graph has a node at least."""
    each = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.groupBy("graph").agg(F.count(F.lit(1)).alias("n_edges")), "graph", "left").fillna(0, ["n_edges"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(F.count(F.lit(1)).alias("graphs"), total("n_nodes").alias("nodes"), total("n_edges").alias("edges"), F.round(mean(F.col("n_nodes")), 6).alias("mean_nodes"), F.round(mean(F.col("n_edges")), 6).alias("mean_edges"))

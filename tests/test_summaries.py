"""Summaries on small tables: nulls, unknown values, empty tables, single nodes, and sums that no order changes."""

from pyspark.sql import functions as F

from faultline.operators import summaries


def test_runs_with_unknown_and_missing_statuses(spark):
    rows = spark.createDataFrame([("a", "valid", True), ("a", "valid", False), ("a", "odd", None), ("a", None, False), ("b", "timeout", None)], "repo string, status string, is_valid boolean")
    got = {r.repo: r for r in summaries.run_totals(rows, ["repo"]).collect()}
    assert (got["a"].total, got["a"].valid, got["a"].error, got["a"].valid_bugs, got["a"].success_rate) == (4, 2, 2, 1, "25.0%")
    assert (got["b"].timeout, got["b"].error, got["b"].success_rate) == (1, 0, "0.0%")
    assert [r.success_rate for r in summaries.run_totals(rows.where("false"), []).collect()] == ["0%"]


def test_groups_and_means(spark):
    rows = spark.createDataFrame([("x", True, 1.0, None), ("x", False, 0.5, 2.0), ("x", None, 9.0, None), ("y", True, None, None)], "k string, f boolean, a double, b double")
    by = {r.metric: r for r in summaries.compared_groups(rows, "f", ["a", "b"]).collect()}
    assert (by["a"].mean, by["a"].mean_true, by["a"].mean_false, by["a"].delta, by["a"].notable) == (3.5, 1.0, 0.5, 0.5, True)
    assert (by["b"].mean_true, by["b"].mean_false, by["b"].delta) == (0.0, 2.0, -2.0)
    means = {r.k: r for r in summaries.grouped_means(rows, ["k"], ["a", "b"], "f", ("b",)).collect()}
    assert (means["x"].n, means["x"].a, means["x"].b, means["x"].f_pct) == (3, 3.5, 0.666667, 33.3333)
    assert (means["y"].n, means["y"].a, means["y"].b, means["y"].f_pct) == (1, 0.0, 0.0, 100.0)


def test_means_do_not_depend_on_partitions(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 0.1 + 1e-7).alias("v"))
    found = {p: sorted(map(tuple, rows.repartition(p).groupBy("k").agg(summaries.mean(F.col("v")).alias("m")).collect())) for p in (1, 4, 211)}
    assert found[1] == found[4] == found[211]


def test_localizations(spark):
    rows = spark.createDataFrame([("main", ["a"], ["f"], ["a"], ["f"], ["b"], []), ("other", ["a", "b"], ["f", "g"], ["a"], [], ["a", "b", "c"], ["g"]), (None, [], [], ["z"], ["z"], [], [])], "repo string, true_files array<string>, true_entities array<string>, one_files array<string>, one_entities array<string>, two_files array<string>, two_entities array<string>")
    got = {r.method: (r.n, r.file_coverage, r.entity_overlap) for r in summaries.compared_methods(rows, ["one", "two"]).collect()}
    assert got == {"one": (3, 0.5, 0.333333), "two": (3, 0.333333, 0.166667)}
    outside = summaries.located_outside(rows.select("repo", F.col("two_files").alias("found_files"), F.col("two_entities").alias("functions"), "true_files"), "main").collect()
    assert [tuple(r) for r in outside] == [(2, 1, 1.5, 0.5, 1)]
    assert [tuple(r) for r in summaries.located_outside(rows.where("false").select("repo", F.col("two_files").alias("found_files"), F.col("two_entities").alias("functions"), "true_files"), "main").collect()] == [(0, 0, 0.0, 0.0, 0)]


def test_graphs_together(spark):
    nodes = spark.createDataFrame([("g", "a", "function", "def a(x):\n  return x"), ("g", "b", "function", None), ("g", "c", "class", "x = 1"), ("g", "alone", "file", ""), ("h", "a", "class", "a b"), ("h", "b", "class", None), ("k", "s", "function", "é()")], "graph string, node string, type string, code string")
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("h", "a", "b"), ("h", "b", "a"), ("k", "s", "s")], "graph string, src string, dst string")
    got = {r.graph: r for r in summaries.graph_profiles(nodes, edges).collect()}
    g, h, k = got["g"], got["h"], got["k"]
    assert (g.n_nodes, g.n_edges, g.density, g.is_dag, g.n_components, g.n_leaves, g.leaf_tokens, g.mean_leaf_tokens, g.n_functions, g.mean_function_chars) == (4, 2, 0.166667, True, 2, 2, 3, 1.5, 2, 10.0)
    assert (h.is_dag, h.n_components, h.n_leaves, h.mean_leaf_tokens, h.n_functions, h.mean_function_chars, h.max_in, h.max_out) == (False, 1, 0, 0.0, 0, 0.0, 1, 1)
    assert (k.n_nodes, k.density, k.is_dag, k.n_components) == (1, 0.0, False, 1)
    assert [tuple(r) for r in summaries.graph_totals(nodes, edges).collect()] == [(3, 7, 5, 2.333333, 1.666667)]

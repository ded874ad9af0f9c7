"""What no result needs is not searched, and what several steps read is made once."""

import duckdb
from pyspark.sql import functions as F

from faultline.operators import centrality, localization, paths
from faultline.plans import graph_queries
from faultline.plans.registry import ORACLES


def test_typed_paths_of_odd_orders(spark, tmp_path, monkeypatch):
    """Line numbers around 62 and below 0, gaps, negative and null keys; the searched edges are a stored table."""
    lines = [(k, n) for k in range(12) for n in (1, 2, 3, 4, 61, 62, 63, 64)] + [(-5, 1), (-5, 2), (3, -1), (3, 0), (3, 123), (3, 124), (None, 5), (4, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k,) for k in range(-3, 30)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    seen = []
    found = paths.shortest_paths
    monkeypatch.setattr(paths, "shortest_paths", lambda edges, *rest: seen.append(edges) or found(edges, *rest))
    got = graph_queries.typed_paths(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.sql(ORACLES["typed_paths"].replace("^f[0-9]*5_4$", "^f[0-9]*5_(4|64)$")).fetchall()
    assert {(r.source, r.target): (r.path, r.types) for r in got.collect()} == {(a, b): (c, d) for a, b, c, d in want if b.endswith("_4")} and got.count()
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    edges = {(r.src, r.dst) for r in seen[0].where("type = 'invokes'").collect()}
    step = con.sql("SELECT DISTINCT concat('f', a.l_orderkey % 12, '_', a.l_linenumber), concat('f', a.l_orderkey % 12, '_', b.l_linenumber) FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1").fetchall()
    assert edges == set(step) and ("f0_61", "f0_62") in edges and ("f3_-1", "f3_0") in edges


def test_difficulty_searches_graphs_of_roots_alone(spark, monkeypatch):
    asked = []
    whole = centrality.betweenness
    monkeypatch.setattr(centrality, "betweenness", lambda edges, graph: asked.append(edges) or whole(edges, graph))
    edges = spark.createDataFrame([("a", "x", "y"), ("a", "y", "z"), ("b", "x", "y"), ("b", "y", "z"), ("b", "y", "z")], "graph string, src string, dst string")
    roots = spark.createDataFrame([("a", "y", 4), ("c", "y", 7)], "graph string, node string, chain int")
    got = {r.graph: (r.in_degree, r.out_degree, r.depth, r.betweenness) for r in centrality.root_difficulty(roots, edges, F.col("chain")).collect()}
    assert got == {"a": (1, 1, 1, 0.5), "c": (0, 0, 7, 0.0)}
    assert {r.graph for r in asked[0].collect()} == {"a"}


def test_callers_are_looked_up_for_keys_without_a_path(spark, monkeypatch):
    asked = []
    whole = paths.upstream
    monkeypatch.setattr(paths, "upstream", lambda edges, targets, limit: asked.append(targets) or whole(edges, targets, limit))
    edges = spark.createDataFrame([("tests/t.py", "a.py:f", "invokes"), ("b.py", "a.py:g", "invokes")], "src string, dst string, type string")
    nodes = spark.createDataFrame([(x,) for x in ("tests/t.py", "a.py:f", "a.py:g", "b.py")], "node string")
    patch = lambda f: f"--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@ def {f}(x):\n-a\n+b"
    test = "--- a/tests/t.py\n+++ b/tests/t.py\n@@ -1 +1 @@\n+x"
    rows = spark.createDataFrame([(1, patch("f"), test), (2, patch("g"), test)], "key long, patch string, test_patch string")
    got = {r.key: r.graph_node_ids for r in localization.localize(rows, nodes, edges).collect()}
    assert got == {1: ["tests/t.py", "a.py:f"], 2: ["b.py"]}
    assert [r.target for r in asked[0].collect()] == ["a.py:g"]


def test_ablations_of_any_depth_ask_for_no_depths(spark, monkeypatch):
    from faultline.plans import seed_queries

    def refused(*_):
        raise AssertionError("depths are searched")

    monkeypatch.setattr(paths, "test_depths", refused)
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "supplier", "part", "lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    got = sorted((r.seed, r.node, r.final_score, r["rank"]) for r in seed_queries.candidate_ablations(spark, d).collect())
    want = sorted(con.sql(ORACLES["candidate_ablations"]).fetchall())
    assert got and [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, want, strict=True))

"""Steps whose rows grew with the square of a hub, a repository or a library, or that ran anew for every reader."""

import ast
import time

from pyspark.sql import functions as F

from faultline.operators import code_graph, graph, paths, stats
from faultline.plans.fixtures import code_edges
from faultline.sources import exports

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_code_graph_is_made_once(spark):
    assert "Join" not in plan(code_edges(spark, SF))


def test_edges_of_a_hub_are_looked_up_from_their_other_ends(spark):
    edges = spark.createDataFrame([("hub", f"n{i}") for i in range(40)] + [(f"n{i}", f"n{i + 1}") for i in range(39)], "src string, dst string")
    around = paths.neighbourhoods(edges, edges.select(F.col("dst").alias("anchor")))
    kinds = around.select("node").distinct().withColumn("type", F.lit("x"))
    found = paths.subgraphs(edges, around, kinds)
    assert "n_src" in plan(found)
    rows = {r.anchor: (r.n_nodes, r.n_edges) for r in found.collect()}
    assert rows["n5"] == (4, 5) and rows["n0"] == (3, 3) and len(rows) == 40


def test_neighbours_take_one_shuffle_a_side(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b"), ("c", "b")], "src string, dst string")
    found = graph.capped_neighbours(edges, 1)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    assert {r.node: (r.outgoing, r.incoming, r.n_out, r.n_in) for r in found.collect()} == {"a": (["b"], [], 2, 0), "b": ([], ["a"], 0, 2), "c": (["b"], ["a"], 1, 1)}


def test_a_key_that_has_its_path_is_searched_no_further(spark, monkeypatch):
    edges = spark.createDataFrame([("t", "r"), ("u5", "u4"), ("u4", "u3"), ("u3", "u2"), ("u2", "r"), ("t", "u5")], "src string, dst string")
    roots = spark.createDataFrame([("k", "r", 0), ("none", "u2", 0)], "key string, node string, ord int")
    tests = spark.createDataFrame([("k", "t", 0)], "key string, node string, ord int")
    made, whole = [], paths.levels
    monkeypatch.setattr(paths, "levels", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    assert [tuple(r) for r in paths.skeletons(edges, tests, roots).collect()] == [("k", ["t", "r"])]
    searched = [x for x in made if "target" in x[0].columns]
    assert [len(x) for x in searched] == [2]


def test_pools_of_one_repository_are_not_paired_with_its_commits(spark):
    ids = spark.range(40000)
    asked = ids.select(F.lit("r").alias("repo"), F.md5(F.col("id").cast("string")).alias("commit"))
    kept = F.when(F.col("id") % 3 == 0, F.substring(F.md5(F.col("id").cast("string")), 1, 8)).when(F.col("id") % 3 == 1, F.md5(F.col("id").cast("string"))).otherwise("zz")
    pools = ids.select(F.concat(F.lit("p"), "id").alias("pool"), F.lit("r").alias("repo"), kept.alias("commit"), F.when(F.col("id") % 2 == 0, 2).otherwise(1).alias("version"), F.timestamp_seconds("id").alias("mtime"))
    start = time.time()
    found = {r.commit: r.pool for r in exports.chosen_pools(asked, pools).join(ids.select("id", F.md5(F.col("id").cast("string")).alias("commit")), "commit").where("id < 6").select(F.col("id").alias("commit"), "pool").collect()}
    assert found == {0: "p0", 1: "p39998", 2: "p39998", 3: "p39998", 4: "p4", 5: "p39998"}
    assert time.time() - start < 30


def test_equal_spans_are_one(spark):
    spans = spark.createDataFrame([("a", i, 0, 9) for i in (3, 1, 2)], "k string, id int, s int, e int")
    points = spark.createDataFrame([("a", 5), ("a", 50)], "k string, at int")
    found = stats.innermost(points, spans, ["k"], "at", "s", "e", "id")
    text = plan(found)
    assert text.rindex("Aggregate") > text.rindex("Generate")
    assert sorted((r["at"], r["id"]) for r in found.collect()) == [(5, 1), (50, None)]


def test_code_of_nodes_is_cut_from_lines_split_once():
    text = "x = 'ä'; \f\ndef f(): return 'é'\r\nclass C:\r    def run(self):\n        '''ö\f\n        ü'''\n        return 1; y = 2\nif x: pass\n" + "".join(f"def g{i}(a):\n    return a\n" for i in range(3000))
    start = time.time()
    rows = [r for r in code_graph._Reader("m.py", text).rows if r["row"] == "node"]
    assert time.time() - start < 1.5
    tree = [x for x in ast.walk(ast.parse(text)) if isinstance(x, ast.ClassDef | ast.FunctionDef)]
    want = {(x.name, x.lineno): ast.get_source_segment(text, x) for x in tree[:40]}
    got = {(r["name"], r["start_line"]): r["code"] for r in rows}
    assert {k: got[k] for k in want} == want and len(rows) == len(tree)


def test_names_are_looked_up_by_callers_that_ask(spark):
    content = "".join(f"def g{i}(a):\n    return g{i + 1}(a)\n" for i in range(2000))
    files = spark.createDataFrame([("r", "m.py", content)], "graph string, path string, content string")
    start = time.time()
    edges = code_graph.build(code_graph.read_files(files))[1].where("type = 'invokes'")
    assert edges.count() == 1999
    assert time.time() - start < 60

"""Operators that SQL cannot hold against: graphs from source files, centrality, localization, exports, watchers."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from faultline.functions import answers, gates
from faultline.operators import centrality, code_graph, localization
from faultline.sources import exports
from faultline.streaming import watch

FILES = {
    "app/__init__.py": "from .core import run as go\nfrom .util import *\n",
    "app/core.py": "import app.util as u\nfrom app.util import helper\n\nclass Base:\n    def __init__(self):\n        helper()\n    def stop(self):\n        pass\n\nclass Main(Base):\n    class In:\n        def deep(self):\n            pass\n    def run(self):\n        def inner():\n            helper()\n        self.stop()\n        deep()\n        inner()\n\ndef run(x):\n    import os\n    return Main().run()\n",
    "app/util.py": "def helper():\n    return hidden()\n\nasync def later():\n    await helper()\n",
    "tests/test_core.py": "from app import go\n\ndef test_go():\n    go(1)\n    hidden()\n",
    "bad/x.py": "def (\n",
    "docs/readme.txt": "no code",
    "node_modules/y.py": "x = 1\n",
    "other/z.py": "def hidden():\n    pass\n",
}


def built(spark, **options):
    files = spark.createDataFrame([("g", k, v) for k, v in FILES.items()], "graph string, path string, content string")
    return code_graph.build(code_graph.read_files(files), **options)


def test_a_repository_as_a_graph(spark):
    nodes, edges = built(spark)
    kinds = {r.node: r.type for r in nodes.collect()}
    assert {k for k, t in kinds.items() if t == "directory"} == {"/", "app", "tests", "other"}
    assert {k for k, t in kinds.items() if t == "class"} == {"app/core.py:Base", "app/core.py:Main", "app/core.py:Main.In"}
    assert "app/core.py:Base.__init__" not in kinds and kinds["app/core.py:Main.run.inner"] == "function" and kinds["app/util.py:later"] == "function"
    found = {(r.type, r.src, r.dst, r.alias) for r in edges.collect()}
    assert {("contains", "/", "app", None), ("contains", "app", "app/core.py", None), ("contains", "app/core.py:Main.In", "app/core.py:Main.In.deep", None)} <= found
    assert {x[1:] for x in found if x[0] == "imports"} == {
        ("app/__init__.py", "app/core.py:run", "go"),
        ("app/__init__.py", "app/util.py", None),
        ("app/core.py", "app/util.py", "u"),
        ("app/core.py", "app/util.py:helper", None),
        ("tests/test_core.py", "app/__init__.py", None),
    }
    assert {x[1:3] for x in found if x[0] == "inherits"} == {("app/core.py:Main", "app/core.py:Base")}
    calls = {x[1:3] for x in found if x[0] == "invokes"}
    assert calls == {
        ("app/core.py:Base", "app/util.py:helper"),
        ("app/core.py:Main.run", "app/core.py:Base.stop"),
        ("app/core.py:Main.run", "app/core.py:Main.In.deep"),
        ("app/core.py:Main.run", "app/core.py:Main.run.inner"),
        ("app/core.py:Main.run.inner", "app/util.py:helper"),
        ("app/core.py:run", "app/core.py:Main"),
        ("app/core.py:run", "app/core.py:Main.run"),
        ("app/util.py:later", "app/util.py:helper"),
        ("tests/test_core.py:test_go", "app/core.py:run"),
    }
    _, wide = built(spark, global_names=True)
    more = {(r.src, r.dst) for r in wide.where("type = 'invokes'").collect()} - calls
    assert more == {("app/util.py:helper", "other/z.py:hidden"), ("tests/test_core.py:test_go", "other/z.py:hidden")}


def test_centrality_against_all_paths(spark):
    edges = {("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("d", "f"), ("b", "e"), ("f", "b")}
    names = sorted({x for e in edges for x in e})

    def shortest(s, t):
        for n in range(2, len(names) + 1):
            found = [p for p in itertools.permutations(names, n) if p[0] == s and p[-1] == t and all(x in edges for x in itertools.pairwise(p))]
            if found:
                return found
        return []

    want = dict.fromkeys(names, 0.0)
    for s, t in itertools.permutations(names, 2):
        ps = shortest(s, t)
        for p in ps:
            for v in p[1:-1]:
                want[v] += 1 / len(ps)
    df = spark.createDataFrame([("g", *e) for e in edges] + [("h", "x", "y")], "graph string, src string, dst string")
    got = {(r.graph, r.node): r.betweenness for r in centrality.betweenness(df).collect()}
    assert all(abs(got["g", k] - v / 20) < 1e-5 for k, v in want.items()) and got["h", "x"] == 0
    sampled = {(r.graph, r.node): r.betweenness for r in centrality.betweenness(df, exact=3, samples=6).collect()}
    assert all(abs(sampled["g", k] - v / 20) < 1e-5 for k, v in want.items())  # as many samples as nodes


def test_localization_by_patch_and_graph(spark):
    edges = spark.createDataFrame([("tests/t.py:test_a", "lib/m.py:mid", "invokes"), ("lib/m.py:mid", "lib/m.py:f", "invokes"), ("lib/m.py:top", "lib/m.py:mid", "invokes")], "src string, dst string, type string")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().union(spark.createDataFrame([("lib/m.py",), ("lib/other.py",)], "node string"))
    patch = "--- a/m.py\n+++ b/m.py\n@@ -1,2 +1,2 @@ def f(x):\n-a\n+b\n"
    test = "--- a/tests/t.py\n+++ b/tests/t.py\n@@ -1 +1,2 @@ def test_a():\n+x\n"
    rows = [(1, patch, test), (2, patch, ""), (3, "", ""), (4, patch.replace("m.py", "gone.py"), test), (5, "--- a/lib/other.py\n+++ b/lib/other.py\n@@ -1 +1 @@\n-a\n+b\n", "")]
    got = {r.key: r for r in localization.localize(spark.createDataFrame(rows, "key int, patch string, test_patch string"), nodes, edges).collect()}
    assert got[1].graph_node_ids == ["tests/t.py:test_a", "lib/m.py:mid", "lib/m.py:f"] and got[1].found_entities == ["m.py:f"] and got[1].quality_score == 1.0
    assert got[1].raw_output_loc.startswith("tests/t.py\nfunction: test_a\nDescription: test entry point / symptom\n") and "root cause" in got[1].raw_output_loc
    assert got[2].graph_node_ids == ["lib/m.py:top", "tests/t.py:test_a", "lib/m.py:mid"] and got[2].quality_score == 0.7
    assert got[3].found_files == [] and got[3].raw_output_loc == "" and got[3].quality_score == 0.15
    assert got[4].graph_node_ids == [] and got[4].raw_output_loc == "gone.py\nfunction: f\nDescription: modified in patch\n"
    assert got[5].found_entities == [] and got[5].raw_output_loc == "lib/other.py\nDescription: modified file\n"
    skipped = {r.key: r.skip_reason for r in localization.acceptance(spark.createDataFrame([(1, 1.0), (2, 0.5)], "key int, patch_coverage double").selectExpr("*", "array('a') AS found_files", "array('a') AS found_entities", "array('a') AS graph_node_ids")).collect()}
    assert skipped == {1: None, 2: "patch coverage 0.50 < 1.00"}


def test_exports(spark, tmp_path):
    row = dict.fromkeys(exports.STANDARD, "x")
    df = spark.createDataFrame([{**row, "instance_id": "a", "synthetic": True}, {**row, "instance_id": "b", "repo": None, "synthetic": True}, {**row, "instance_id": "c", "synthetic": False}])
    assert sorted(r.instance_id for r in exports.standard(df).collect()) == ["a", "b"] and exports.standard(df).columns == list(exports.STANDARD)
    assert [tuple(r) for r in exports.invalid_rows(df).collect()] == [("b", ["repo"])]
    bug = spark.createDataFrame([("i", "r", "c", "p", "d", "t", ["f"], [], "s", "k", ["a", "b", "c"]), ("j", "r", "c", "p", "d", "t", [], [], "s", "k", None)], "instance_id string, repo string, base_commit string, problem_statement string, patch string, test_patch string, fail array<string>, keep array<string>, seed_id string, fix_intent string, chain array<string>")
    got = {r.instance_id: r for r in exports.exported(bug).collect()}
    assert got["i"].FAIL_TO_PASS == '["f"]' and json.loads(got["i"].metadata)["chain_length"] == 2 and json.loads(got["j"].metadata)["chain_depth"] == 0
    line = {"instance_id": "a", "meta_data": {"repo": "r", "base_commit": "c", "patch": "p", "problem_statement": "s"}, "found_files": ["f"]}
    (tmp_path / "loc.jsonl").write_text("\n".join(["{broken", json.dumps({"instance_id": "no"}), "", *[json.dumps({**line, "instance_id": f"a{k}"}) for k in range(12)]]))
    located = exports.located_instances(spark, str(tmp_path / "loc.jsonl"))
    assert sorted(r.instance_id for r in located.collect()) == sorted(f"a{k}" for k in range(10)) and located.first().FAIL_TO_PASS == "[]"
    tool = exports.tool_instances(spark.createDataFrame([("Own__x-1", "p", "it's")], "instance_id string, problem_statement string, patch string"), "img.").first()
    assert tool.image_name == "img.own_1776_x-1:latest" and tool.setup == "printf %s 'it'\"'\"'s' | git apply -"
    table = exports.latex_table(spark.createDataFrame([("a_b", 5)], "name string, n int"), ["name", "n"], "50 % more")
    assert r"a\_b & 5 \\" in table and r"\caption{50 \% more}" in table
    with pytest.raises(ValueError):
        exports.latex_table(spark.range(9), ["id"], "x", limit=5)
    for k in "ab":
        exports.save_each(spark.createDataFrame([(k, 1)], "k string, n int"), str(tmp_path / "each"), "k")
    assert spark.read.json(str(tmp_path / "each")).count() == 2
    exports.level_files(spark.createDataFrame([("L1", "i", "t"), ("L2", "i", "u")], "level string, instance_id string, problem_statement string"), str(tmp_path / "levels"))
    assert spark.read.json(str(tmp_path / "levels/level=L2")).first().problem_statement == "u"


def test_graphs_and_pools_as_tables(spark, tmp_path):
    nodes, edges = built(spark)
    exports.save_graph(nodes, edges, str(tmp_path / "g"))
    exports.save_graph(nodes.withColumn("graph", F.lit("h")), edges.withColumn("graph", F.lit("h")), str(tmp_path / "g"))
    a, b = exports.load_graph(spark, str(tmp_path / "g"), "g")
    assert a.count() == nodes.count() and b.count() == edges.count() and exports.load_graph(spark, str(tmp_path / "g"))[0].count() == 2 * nodes.count()
    new = spark.createDataFrame([(f"h{k}", [float(k)]) for k in range(7)], "hash string, v array<double>")
    assert exports.save_pool(new.limit(5), str(tmp_path / "p"), batch=2) == 3
    assert exports.save_pool(new, str(tmp_path / "p"), batch=2) == 1 and exports.save_pool(new, str(tmp_path / "p"), batch=2) == 0
    assert exports.load_pool(spark, str(tmp_path / "p")).count() == 7
    pools = spark.createDataFrame([("p1", "r", "12345678", 2, "2024-01-01"), ("p2", "r", "1234567890", 2, "2024-01-02"), ("p3", "r", "zz", 2, "2024-01-09"), ("p4", "q", "12345678", 1, "2024-01-01"), ("p5", "s", "x", 1, "2024-01-01")], "pool string, repo string, commit string, version int, mtime string").withColumn("mtime", F.to_timestamp("mtime"))
    asked = spark.createDataFrame([("r", "1234567890"), ("r", "other"), ("q", "1234567890"), ("none", "x")], "repo string, commit string")
    assert {(r.repo, r.commit): r.pool for r in exports.chosen_pools(asked, pools).collect()} == {("r", "1234567890"): "p1", ("r", "other"): "p3", ("q", "1234567890"): "p4", ("none", "x"): None}
    ids = spark.createDataFrame([(0, "a"), (1, "b")], "position int, node string")
    vectors = spark.createDataFrame([(1, [2.0]), (0, [1.0])], "position int, v array<double>")
    assert {r.node: r.v for r in exports.pool_of_ids(ids, vectors).collect()} == {"a": [1.0], "b": [2.0]}


def test_samples_repeat(spark):
    n = spark.createDataFrame([("g", f"n{k:02}") for k in range(40)] + [("h", "x")], "graph string, node string")
    assert [r.node for r in exports.shuffled(n, "node", 3, 5).collect()] == [r.node for r in exports.shuffled(n.repartition(7), "node", 3, 5).collect()]
    got = exports.filled_sample(n, F.col("node") >= "n10").collect()
    assert len([r for r in got if r.graph == "g" and r.node >= "n10"]) == 15 and len([r for r in got if r.graph == "g"]) == 20 and len(got) == 21


def test_progress_and_markers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "instance_id string, repo string"
    from pyspark.sql.types import StructType

    fields = StructType().add("instance_id", "string").add("repo", "string")
    expected = spark.createDataFrame([("r", 2)], "repo string, expected long")

    def run():
        handler = watch.progress(spark, str(folder), fields, expected, str(tmp_path / "state"))
        watch.drain(watch.new_details(spark, str(folder), fields), str(tmp_path / "cp"), handler).awaitTermination()

    (folder / "a.json").write_text('{"instance_id": "a", "repo": "r"}')
    run()
    assert not (tmp_path / "state/complete").exists() and spark.read.json(str(tmp_path / "state/progress")).first().actual == 1
    (folder / "b.json").write_text('{"instance_id": "b", "repo": "r"}')
    run()
    assert (tmp_path / "state/complete").exists() and schema
    log = tmp_path / "run.log"
    log.write_text("Stage 3 begins\n" + "x" * 300_000)
    assert not watch.ends_with_marker(spark, str(log), "Stage 3 begins")
    log.write_text("x" * 300_000 + "Stage 3 begins")
    query = spark.readStream.format("rate").load().writeStream.format("noop").start()
    assert watch.stop_at_marker(query, spark, str(log), "Stage 3 begins") and not query.isActive


def test_python_rules():
    assert gates.parses("    x = 1\n") and not gates.parses("x = (") and gates.parses(None)
    assert gates.wordy_change("x = 1", "x = 1  # why") == "new comments" and gates.wordy_change("x = '# no'", "x = '# no, no'") is None
    assert gates.wordy_change('def f():\n    "a"\n', 'def f():\n    "b"\n') == "docstrings changed" and gates.wordy_change("# a\nx = 1", "x = 1") is None
    assert gates.token_entropy("a a") == 0.0 and gates.token_entropy("a = b") == pytest.approx(1.584962, abs=1e-5) and gates.token_entropy("x = '") == pytest.approx(1.584962, abs=1e-5)
    assert answers.usage_records({"a": [{"model": "m", "prompt_tokens": 3, "completion_tokens": 2}], "prompt": {"model": "x", "input": 1}}) == [{"model": "m", "input_tokens": 3, "output_tokens": 2, "cache_write": 0, "cache_read": 0, "timestamp": ""}]
    assert answers.unified_patch("a.py", "1\n2\n3\n4\n5\n", "3", "x", 3) == "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,5 +1,5 @@\n 1\n 2\n-3\n+x\n 4\n 5\n"
    assert answers.unified_patch("a.py", None, "a", "a", 1) == ""

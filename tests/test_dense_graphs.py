"""Components, depths and nodes of graphs with many more edges than nodes: against plain Python, without storing the edges anew."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import graph, paths, searches
from faultline.plans import fixtures


@pytest.fixture
def written(monkeypatch):
    """The number of rows of each stored table."""
    sizes = []

    def counting(stored):
        def count(df):
            out = stored(df)
            sizes.append(out.count())
            return out

        return count

    for module in (graph, paths, searches):
        monkeypatch.setattr(module, "stored", counting(module.stored))
    return sizes


def dense(seed):
    rng = random.Random(seed)
    sides = [[f"n{k}" for k in range(g, 60, 2)] for g in (0, 1)]
    return [(rng.choice(sides[k % 2]), rng.choice(sides[k % 2])) for k in range(3000)] + [("z9", "z1"), ("z1", "z5"), ("z7", "z7"), ("z5", None)]


def test_components_of_dense_graphs(spark, written):
    rows = dense(1)
    names = sorted({x for r in rows for x in r if x})
    want = {x: ("z7" if x == "z7" else "z1") if x[0] == "z" else "n0" if int(x[1:]) % 2 == 0 else "n1" for x in names}
    edges = spark.createDataFrame(rows, "src string, dst string")
    got = graph.weak_components(edges, spark.createDataFrame([(x,) for x in names], "node string")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want) and sum(written) < 1000
    assert {r.node: r.component for r in graph.weak_components(edges).collect()} == want


def test_components_of_a_long_chain_and_a_star(spark):
    rng = random.Random(2)
    turn = [f"c{k}" for k in rng.sample(range(1000), 300)]
    rows = list(zip(turn, turn[1:], strict=False)) + [("zz", f"s{k}") for k in range(200)] + [(f"t{k}", "zy") for k in range(200)]
    got = {r.node: r.component for r in graph.weak_components(spark.createDataFrame(rows, "src string, dst string")).collect()}
    low = {"c": min(turn), "s": "s0", "t": "t0"}
    assert got == {x: low[x[0]] for r in rows for x in r if x[0] != "z"} | {"zz": "s0", "zy": "t0"}


def test_depths_of_dense_graphs(spark, written):
    rows = [r for r in dense(3) if None not in r]
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
    depth, last = {"n0": 1, "z9": 1}, ["n0", "z9"]
    for k in range(2, 12):
        last = sorted({y for x in last for y in near.get(x, ())} - depth.keys())
        depth |= dict.fromkeys(last, k)
    edges = spark.createDataFrame(rows, "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for r in rows for x in r})], "node string")
    got = {r.node: r.depth for r in paths.test_depths(edges, nodes, F.col("node").isin("n0", "z9")).collect()}
    assert got == {r.node: depth.get(r.node, 3) for r in nodes.collect()} and sum(written) < 1000


def test_nodes_of_odd_tables(spark, tmp_path):
    """Lines without a supplier are nodes only as parts, or as ends of imports; repeated keys."""
    tables = {
        "nation": ([(1, 0), (2, 0)], "n_nationkey long, n_regionkey long"),
        "supplier": ([(4, 1), (5, 2), (5, 2)], "s_suppkey long, s_nationkey long"),
        "part": ([(10,), (11,), (11,)], "p_partkey long"),
        "lineitem": ([(1, 1, 4, 10), (1, 2, 9, 70), (1, 3, 5, 71), (2, 1, 9, 80), (2, 3, 9, 81), (3, 1, 9, 90), (3, 2, 9, 90), (4, 1, 4, 72)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    edges = fixtures.code_edges(spark, str(tmp_path))
    want = sorted(map(tuple, fixtures.code_nodes(edges).collect()))
    assert sorted(map(tuple, fixtures.table_nodes(spark, str(tmp_path), edges).collect())) == want
    assert "lib/m20.py:f70" in dict(want) and "lib/m30.py:f80" not in dict(want)

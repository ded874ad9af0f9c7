"""Searches on graphs against plain Python: components, paths, centrality, retrieval by blocks, first edits."""

import difflib
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import edits
from faultline.operators import centrality, code_graph, paths, strong, topk


def reach(start, near):
    seen, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def random_graphs(seed, n_graphs=3):
    rng = random.Random(seed)
    rows = []
    for g in range(n_graphs):
        n = rng.choice([3, 6, 10, 25])
        rows += [(f"g{g}", f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(int(n * rng.choice([0.8, 1.2, 1.6, 2.5])))]
    return rows


def test_strong_components_of_many_graphs(spark):
    """Random graphs, a chain and a ring of 400 nodes in no order of names, a ladder, a loop and null ends, in one pass."""
    rng, n = random.Random(7), 400
    rows = random_graphs(1)
    turn = list(range(n))
    rng.shuffle(turn)
    chain = [("chain", f"c{i}", f"c{i + 1}") for i in range(n)]
    ring = [("ring", f"r{turn[i]}", f"r{turn[i - 1]}") for i in range(n)]
    ladder = [("ladder", f"{x}{i:02}", f"{y}{i + 1:02}") for i in range(3) for x in "ab" for y in "ab"] + [("loop", "x", "x"), ("loop", "x", None)]
    df = spark.createDataFrame(rows + chain + ring + ladder, "graph string, src string, dst string")
    got = {(r.graph, r.node): r.component for r in strong.strong_components(df).collect()}
    assert {v for (g, _), v in got.items() if g == "ring"} == {"r0"} and all(k == v for (g, k), v in got.items() if g in ("chain", "ladder", "loop"))
    for g in {r[0] for r in rows}:
        out, back = defaultdict(set), defaultdict(set)
        for _, a, b in (r for r in rows if r[0] == g):
            out[a].add(b)
            back[b].add(a)
        for x in {*out, *back}:
            assert got[g, x] == min(reach(x, out).keys() & reach(x, back).keys())
    cyclic = {r.graph: r.cyclic for r in strong.cyclic_graphs(df.where("graph in ('ladder', 'loop', 'g0')")).collect()}
    assert not cyclic["ladder"] and cyclic["loop"]


def test_paths_against_breadth_first_search(spark):
    rng = random.Random(3)
    names = [f"n{k:02}" for k in range(40)]
    rows = [("e", rng.choice(names), rng.choice(names), rng.choice(["invokes", "imports"])) for _ in range(70)] + [("e", f"l{i:03}", f"l{i + 1:03}", "invokes") for i in range(16)]
    df = spark.createDataFrame([r[1:] for r in rows], "src string, dst string, type string")
    near = defaultdict(set)
    for _, a, b, _ in rows:
        near[a].add(b)
    sources, targets = [*names[:9], "l000", "l007"], [*names[5:20], "l016", "none"]

    def best(s, t):
        """Of the shortest paths the first in order of names."""
        layer = {s: [s]}
        seen = {s}
        while layer:
            if t in layer:
                return layer[t]
            nxt = {}
            for v, p in layer.items():
                for w in near[v] - seen:
                    nxt[w] = min(nxt.get(w, [*p, w]), [*p, w])
            seen |= nxt.keys()
            layer = nxt
        return None

    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    for limit in (None, 3):
        got = {(r.source, r.target): r.path for r in paths.shortest_paths(df, frame(sources, "source"), frame(targets, "target"), limit).collect()}
        want = {(s, t): p for s in sources for t in targets if (p := best(s, t)) and (limit is None or len(p) <= limit + 1)}
        assert got == want
    typed = paths.path_types(paths.shortest_paths(df, frame(sources[:4], "source"), frame(targets, "target"), None, ("invokes",)), df.where("type = 'invokes'")).collect()
    assert typed and all(r.types == ["invokes"] * (len(r.path) - 1) for r in typed)


def test_centrality_of_larger_graphs(spark):
    """Two graphs, one of 60 nodes: all-paths sums, degrees and depths from entries in one row."""
    rng = random.Random(5)
    rows = [("big", f"n{rng.randrange(60):03}", f"n{rng.randrange(60):03}") for _ in range(110)] + [("small", "a", "b"), ("small", "b", "c"), ("small", "a", "a")]
    df = spark.createDataFrame(rows, "graph string, src string, dst string")
    near, back = defaultdict(set), defaultdict(set)
    for _, a, b in (r for r in rows if r[0] == "big" and r[1] != r[2]):
        near[a].add(b)
        back[b].add(a)
    names = sorted({x for r in rows if r[0] == "big" for x in r[1:]})
    dist = {s: reach(s, near) for s in names}

    ways = {}
    for s in names:
        ways[s] = {s: 1}
        for v in sorted(dist[s], key=dist[s].get):
            if v != s:
                ways[s][v] = sum(ways[s][u] for u in back[v] if u in dist[s] and dist[s][u] + 1 == dist[s][v])
    want = dict.fromkeys(names, 0.0)
    for s in names:
        for t in dist[s]:
            for v in dist[s]:
                if v not in (s, t) and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    want[v] += ways[s][v] * ways[v][t] / ways[s][t]
    n = len(names)
    got = {(r.graph, r.node): r.betweenness for r in centrality.betweenness(df).collect()}
    assert all(abs(got["big", k] - v / (n - 1) / (n - 2)) < 2e-6 for k, v in want.items()) and got["small", "b"] == 0.5
    roots = spark.createDataFrame([("big", names[3], 4), ("small", "c", 4), ("small", "gone", 7)], "graph string, node string, chain int")
    rows_of = {(r.graph, r.node): r for r in centrality.root_difficulty(roots, df, F.col("chain")).collect()}
    entries = [x for x in names if not any(r[0] == "big" and r[2] == x for r in rows)][:20]
    deep = min((dist[e][names[3]] for e in entries if names[3] in dist[e]), default=4)
    r = rows_of["big", names[3]]
    assert (r.in_degree, r.out_degree, r.depth) == (len({a for g, a, b in rows if g == "big" and b == names[3]}), len({b for g, a, b in rows if g == "big" and a == names[3]}), deep)
    assert rows_of["small", "gone"].depth == 7 and rows_of["small", "gone"].in_degree == 0


def test_scopes_and_packages_of_any_depth(spark):
    """A method under 25 classes, and a name that 35 packages pass on."""
    deep = "".join("    " * k + f"class C{k}:\n" for k in range(25)) + "    " * 25 + "def deep(self):\n" + "    " * 26 + "pass\n"
    files = {"a.py": deep + "\ndef top():\n    deep()\n", "use.py": "from p0 import far\n\ndef go():\n    far()\n", "p35/__init__.py": "def far():\n    pass\n"}
    files |= {f"p{k}/__init__.py": f"from p{k + 1} import far\n" for k in range(35)}
    rows = spark.createDataFrame([("g", k, v) for k, v in files.items()], "graph string, path string, content string")
    _, edges = code_graph.build(code_graph.read_files(rows))
    calls = {(r.src, r.dst) for r in edges.where("type = 'invokes'").collect()}
    assert ("a.py:top", "a.py:" + ".".join(f"C{k}" for k in range(25)) + ".deep") in calls and ("use.py:go", "p35/__init__.py:far") in calls


@pytest.mark.parametrize("block", [5, 4096])
def test_nearest_by_blocks(spark, monkeypatch, block):
    """Against all pairs: ties by name, tests, skipped names, depths, other lengths, and what is looked at on the way."""
    monkeypatch.setattr(topk, "POOL_BLOCK", block)
    monkeypatch.setattr(topk, "SEED_BLOCK", 2)
    rng = np.random.default_rng(block)
    pool = [("p", f"n{k:02}", [float(x) for x in rng.integers(-2, 3, 3)], int(rng.integers(1, 6)), k % 7 == 0) for k in range(40)] + [("p", "odd", [1.0], 2, False), ("q", "x", [1.0, 0.0, 0.0], 2, None), ("p", "none", None, 2, False)]
    seeds = [(k, "p", [float(x) for x in rng.integers(1, 4, 3)], 3, [f"n{k:02}", "n20"]) for k in range(5)] + [(7, "q", [1.0, 1.0, 0.0], 2, None), (8, "p", None, 3, None), (9, "r", [1.0], 3, None)]
    p = spark.createDataFrame(pool, "pool string, node string, v array<double>, depth int, test boolean")
    s = spark.createDataFrame(seeds, "seed int, pool string, v array<double>, aim int, skip array<string>")
    got = topk.nearest(s, p, 6, 1)
    have = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.seed, r.rank)):
        have[r.seed].append((r.node, round(r.score, 9)))
    counts = {r.seed: r for r in topk.scanned(s.where("v is not null"), p, got, 6, 1).collect()}
    for seed, name, v, aim, skip in seeds:
        if v is None:
            assert len(have[seed]) == 6 and all(x == 0 for _, x in have[seed])
            continue
        order = sorted(((-np.dot(w, v) / (np.linalg.norm(w) * np.linalg.norm(v) + 1e-9), n, d, t) for q, n, w, d, t in pool if q == name and w and len(w) == len(v)), key=lambda x: (round(x[0], 12), x[1]))
        free = [x for x in order if x[1] not in (skip or ()) and not x[3] and abs(x[2] - aim) <= 1]
        assert have[seed] == [(n, round(-c, 9)) for c, n, _, _ in free[:6]]
        if name != "r":
            last = order.index(free[5]) + 1 if len(free) >= 6 else len(order)
            seen = order[:last]
            c = counts[seed]
            assert c.scanned == len(seen) and c.originals == sum(n in (skip or ()) for _, n, _, _ in seen) and c.tests == sum(bool(t) and n not in (skip or ()) for _, n, _, t in seen)


def test_first_edits(spark):
    assert edits.first_difference("a1b2", "a3b4") == ("1", "3") and edits.first_difference("same", "same") == ("", "")
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice(["ab", "abcd", "abcdefghij é$"])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 20, 80, 260])))
        b = list(a)
        for _ in range(rng.randrange(4)):
            if b and rng.random() < 0.5:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randrange(len(b) + 1), rng.choice(letters))
        b = "".join(b)
        want = next(((a[i:k], b[j:m]) for op, i, k, j, m in difflib.SequenceMatcher(None, a, b).get_opcodes() if op != "equal"), ("", ""))
        assert edits.first_difference(a, b) == want
    df = spark.createDataFrame([("x = 1", "x = 2"), (None, "y"), ("z", None)], "a string, b string").select(edits.first_edit(F.col("a"), F.col("b")).alias("e"))
    assert sorted(tuple(r.e) for r in df.collect()) == [("", "y"), ("1", "2"), ("z", "")]


def test_centrality_has_no_cut_by_size(spark):
    """More than 20 entries, of which the last by name is nearest; more than 5,000 nodes, of which none is left out as a source."""
    far = [("deep", f"a{k:02}", "hall") for k in range(25)] + [("deep", "hall", "way"), ("deep", "way", "root"), ("deep", "z", "root")]
    wide = [("wide", f"s{k}", "mid") for k in range(20)] + [("wide", "mid", f"t{k}") for k in range(5000)]
    df = spark.createDataFrame(far + wide, "graph string, src string, dst string")
    roots = spark.createDataFrame([("deep", "root", 9), ("wide", "mid", 9)], "graph string, node string, chain int")
    got = {r.graph: (r.in_degree, r.out_degree, r.depth, r.betweenness) for r in centrality.root_difficulty(roots, df, F.col("chain")).collect()}
    assert got == {"deep": (2, 0, 1, 0.0), "wide": (20, 5000, 1, round(20 * 5000 / 5020 / 5019, 6))}

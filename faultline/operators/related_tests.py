"""Tests that bear on a place in the code: cases and assertions read from files, scored by what they mention; commands that run them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: How many files of a place are looked into, how many if none scores, and how many tests are told of.
TOP_FILES, FALLBACK_FILES, TOP_TESTS = 25, 10, 15
_CASE = "array<struct<cls:string,method:string,source:string,assertions:array<string>>>"


def test_cases(path: str, content: str) -> list[dict]:
    """The test functions of a file, and the test methods of its classes but bases and mixins, with their source and assertions; none if it does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []

    def case(cls: str, f: ast.FunctionDef) -> dict:
        found = []
        for x in ast.walk(f):
            name = x.func.attr if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) else x.func.id if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) else ""
            if isinstance(x, ast.Assert) or name.startswith("assert"):
                found.append((ast.get_source_segment(content, x) or "").strip())
        return {"cls": cls, "method": f.name, "source": ast.get_source_segment(content, f) or "", "assertions": [a for a in found if a]}

    out = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef) and node.name.startswith("test_"):
            out.append(case("", node))
        elif isinstance(node, ast.ClassDef) and not node.name.startswith("Base") and not node.name.endswith("Mixin"):
            out += [case(node.name, x) for x in node.body if isinstance(x, ast.FunctionDef) and x.name.startswith("test_")]
    return out


def read_cases(files: DataFrame) -> DataFrame:
    """path, content, test (path::Class::method), source and assertions of each test case of files(path, content)."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cases = [test_cases(p, c or "") for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("cls", pa.string()), ("method", pa.string()), ("source", pa.string()), ("assertions", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cases, kind)], names=["path", "content", "cases"])

    rows = files.select("path", "content").mapInArrow(read, f"path string, content string, cases {_CASE}").select("path", "content", F.explode("cases").alias("c"))
    return rows.select("path", "content", F.array_join(F.filter(F.array("path", "c.cls", "c.method"), lambda x: x != ""), "::").alias("test"), "c.source", "c.assertions")


def asserting_cases(files: DataFrame, limit: int | None = None) -> DataFrame:
    """path, test: the test cases that assert something; with a limit the first by file and name (60 where they go into a prompt)."""
    found = read_cases(files).where(F.size("assertions") > 0).select("path", "test").distinct()
    return found if limit is None else found.orderBy("path", "test").limit(limit)


def mentions(text: Column, words: Column, most: int = 20) -> Column:
    """How often a text holds words (an array), each counted `most` times at most."""
    each = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.least(F.lit(most), ((F.length(text) - F.length(F.replace(text, w, F.lit("")))) / F.length(w)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, n: s + n)


def related_tests(places: DataFrame, files: DataFrame, near: DataFrame) -> DataFrame:
    """place, test, score, target_hit, rank: the tests that bear on a place.

    places: place (file.py:Name.part), words (further keywords, an array); near: place, path, the files that may hold its tests; files: path, content.
    A file scores by the mentions of the place's names, 2 more if its path has the file's stem and 6 if it mentions the target; the best files with a score are read,
    or the first if none has one. A test adds half a point an assertion, 2 for each keyword it holds and 8 if it mentions the target.
    """
    file = F.substring_index("place", ":", 1)
    name = F.when(F.col("place").contains(":"), F.substring_index("place", ":", -1)).otherwise("")
    stem = F.regexp_replace(F.substring_index(file, "/", -1), r"\.py$", "")
    parts = F.when(name.contains("."), F.split(name, r"\.")).otherwise(F.array().cast("array<string>"))
    base = F.when(name.endswith("_with_args"), F.array(F.regexp_replace(name, "_with_args$", ""))).otherwise(F.array().cast("array<string>"))
    marks = F.filter(F.concat(F.array(name), F.when(F.size(parts) > 0, F.array(F.get(parts, 0), F.element_at(parts, -1))).otherwise(parts), base), lambda x: x != "")
    module = F.replace(F.regexp_replace(file, r"\.py$", ""), F.lit("/"), F.lit("."))
    known = places.select("place", stem.alias("stem"), marks.alias("marks"), F.filter(F.concat(F.array(name, stem, module), parts, base, "words"), lambda x: x.isNotNull() & (x != "")).alias("keys"))
    held = lambda text: F.exists("marks", lambda m: F.col(text).contains(m))
    rows = near.join(known, "place").join(files, "path")
    score = mentions(F.col("content"), F.col("keys")) + F.when((F.col("stem") != "") & F.col("path").contains(F.col("stem")), 2).otherwise(0) + F.when(held("content"), 6).otherwise(0)
    rated = rows.select("place", "path", "marks", "keys", score.cast("double").alias("score"), held("content").alias("file_hit"))
    w = Window.partitionBy("place")
    order = F.row_number().over(w.orderBy(F.desc("score"), "path"))
    top = rated.withColumn("best", F.max("score").over(w)).withColumn("k", order).where(F.when(F.col("best") > 0, (F.col("score") > 0) & (F.col("k") <= TOP_FILES)).otherwise(F.col("k") <= FALLBACK_FILES))
    cases = read_cases(files.join(top.select("path").distinct(), "path", "left_semi")).drop("content")
    hit = F.col("file_hit") & held("source")
    local = F.col("score") + 0.5 * F.size("assertions") + 2 * F.size(F.filter("keys", lambda k: F.col("source").contains(k))) + F.when(hit, 8).otherwise(0)
    scored = top.join(cases, "path").select("place", "test", local.alias("score"), hit.alias("target_hit")).groupBy("place", "test").agg(F.max("score").alias("score"), F.bool_or("target_hit").alias("target_hit"))
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "test"))).where(F.col("rank") <= TOP_TESTS)


def importing_tests(sources: DataFrame, tests: DataFrame, k: int = 10) -> DataFrame:
    """source, path, score, rank: the k test files that refer most to a source file, from its import (6 from the package, 4 as a module) and its name (1.5).

    tests: path, content. A pair is looked at only if the content has the source's stem as a word.
    """
    stem = F.regexp_replace(F.substring_index("source", "/", -1), r"\.py$", "")
    s = sources.select("source", stem.alias("word"), F.replace(F.regexp_replace("source", r"/[^/]*$", ""), F.lit("/"), F.lit(".")).alias("parent"), F.replace(F.regexp_replace("source", r"\.py$", ""), F.lit("/"), F.lit(".")).alias("module"))
    words = tests.select("path", "content", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    has = lambda *x: F.col("content").contains(F.concat(*x))
    score = F.when(has(F.lit("from "), "parent", F.lit(" import "), "word"), 6.0).otherwise(0.0) + F.when(has(F.lit("from "), "module", F.lit(" import")) | has(F.lit("import "), "module"), 4.0).otherwise(0.0) + 1.5
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "path"))
    return words.join(s, "word").select("source", "path", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def evaluation_command(tests: Column, runner: Column) -> Column:
    """The command that runs expected tests (an array): top modules for the label runner (runner true), else files for pytest; all tests without any."""
    inner = lambda t: F.regexp_replace(F.get(F.split(t, r" \("), 1), r"\)+$", "")
    top = lambda t: (
        F.when(t.contains(" (") & t.endswith(")"), F.substring_index(inner(t), ".", 1))
        .when(t.startswith("tests/") | t.contains("::"), F.substring_index(F.replace(F.substring_index(t, "::", 1), F.lit("tests/"), F.lit("")), "/", 1))
        .when(t.contains(".") & ~t.contains("/") & ~t.contains(" "), F.substring_index(t, ".", 1))
    )
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull()))), " ")
    say = lambda lead, names, tail: F.when(names == "", F.concat(F.lit(lead), F.lit(tail))).otherwise(F.concat(F.lit(lead + " "), names, F.lit(tail)))
    return F.when(runner, say("./tests/runtests.py", listed(F.transform(tests, top)), " --verbosity=2")).otherwise(say("python -m pytest", listed(F.transform(tests, lambda t: F.substring_index(t, "::", 1))), " -v --tb=short"))


def located_entities(text: Column) -> Column:
    """file:name of the functions that a location report names after a file, in order."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    start = F.struct(F.lit("").alias("file"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        is_file = x.endswith(".py") & ~x.rlike("^(line|function|class|Description):")
        name = F.regexp_extract(x, r"^function:\s*(.+)", 1)
        add = ~is_file & (s["file"] != "") & (name != "")
        return F.struct(F.when(is_file, x).otherwise(s["file"]).alias("file"), F.when(add, F.concat(s["out"], F.array(F.concat(s["file"], F.lit(":"), name)))).otherwise(s["out"]).alias("out"))

    return F.aggregate(lines, start, step)["out"]


def location_counts(text: Column) -> Column:
    """A struct of how many characters, files, functions, lines and descriptions a location report has."""
    n = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(1)))
    files = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^(\S+\.py)[ \t]*$"), F.lit(1)))
    return F.struct(F.length(text).alias("chars"), F.size(files).alias("files"), n(r"(?m)^function:\s*(.+)").alias("functions"), n(r"(?m)^line:\s*(.+)").alias("lines"), n(r"(?m)^Description:\s*(.+)").alias("descriptions"))


def resolved_names(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked(text) with node: the node of that name; of file:name without what stands between; of the same name in a file of the same base name; of the same name anywhere; of the same last part in such a file. Ties by name."""
    base = lambda c: F.substring_index(F.substring_index(c, ":", 1), "/", -1)
    want = asked.select("text").distinct().where(F.col("text").isNotNull())
    name = F.when(F.col("text").contains(":"), F.substring_index("text", ":", -1))
    keyed = want.select("text", F.concat(F.substring_index("text", ":", 1), F.lit(":"), name).alias("plain"), name.alias("name"), base(F.col("text")).alias("base"), F.substring_index(name, ".", -1).alias("last"))
    g = nodes.select("node", F.when(F.col("node").contains(":"), F.regexp_replace("node", "^[^:]*:", "")).alias("name"), base(F.col("node")).alias("base")).withColumn("last", F.substring_index("name", ".", -1))
    step = lambda k, d: d.select("text", F.lit(k).alias("k"), "node")
    tries = step(0, want.join(g, F.col("text") == F.col("node"))).unionByName(step(1, keyed.join(g.select("node"), F.col("plain") == F.col("node"))))
    tries = tries.unionByName(step(2, keyed.select("text", "name", "base").join(g.select("node", "name", "base"), ["name", "base"]))).unionByName(step(3, keyed.select("text", "name").join(g.groupBy("name").agg(F.min("node").alias("node")), "name")))
    tries = tries.unionByName(step(4, keyed.where(F.col("name").contains(".")).select("text", "last", "base").join(g.select("node", "last", "base"), ["last", "base"])))
    best = tries.groupBy("text").agg(F.min_by("node", F.struct("k", "node")).alias("node"))
    return asked.join(best, "text", "left")

"""Test labels, modules and images of repositories, and what tests a source file is likely to have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Repositories with a profile, in order.
PROFILES = ("django/django", "pytest-dev/pytest", "sympy/sympy", "scikit-learn/scikit-learn", "matplotlib/matplotlib", "astropy/astropy", "pydata/xarray", "sphinx-doc/sphinx", "psf/requests", "pylint-dev/pylint")


def profile_of(repo: Column) -> Column:
    """The profile of a repository: of the same name, else the first whose name holds it or lies in it, whatever the case; 'generic' without one."""
    near = lambda r: F.get(F.filter(F.array(*map(F.lit, PROFILES)), lambda p: r.contains(p) | p.contains(r)), F.lit(0))
    # a lambda over one name binds it, so that the expression of the name is there once
    return F.element_at(F.transform(F.array(F.lower(F.trim(repo))), lambda r: F.coalesce(F.when(r.isin(*PROFILES), r), near(r), F.lit("generic"))), 1)


def path_to_module(path: Column) -> Column:
    """tests/a/b.py as a.b."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, "^tests/", ""), r"\.py$", ""), F.lit("/"), F.lit("."))


def to_dotted(test: Column) -> Column:
    """A test id or path as a dotted label; other labels stay."""
    dotted = F.regexp_replace(F.replace(F.replace(test, F.lit("::"), F.lit(".")), F.lit("/"), F.lit(".")), r"^tests\.", "")
    path = F.regexp_replace(test, r"^[./]+(?=tests/)", "")
    return F.when(test.contains("::"), F.replace(dotted, F.lit(".py."), F.lit("."))).when(test.contains("/") & test.endswith(".py"), path_to_module(path)).otherwise(test)


def collapse_label(label: Column) -> Column:
    """A dotted label without its method and its class; two parts are always left."""
    cut = lambda x, hit: F.when((F.size(F.split(x, r"\.")) >= 3) & hit(F.substring_index(x, ".", -1)), F.regexp_replace(x, r"\.[^.]*$", "")).otherwise(x)
    method = cut(F.coalesce(label, F.lit("")), lambda p: p.startswith("test"))
    return cut(method, lambda p: p.rlike("^[A-Z]"))


def pruned(labels: Column) -> Column:
    """Labels in order, each once: only dotted ones if there are any, and none below which another lies."""
    clean = F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != ""))
    kept = lambda xs: F.when(F.exists(xs, lambda x: x.contains(".")), F.filter(xs, lambda x: x.contains("."))).otherwise(xs)
    leaves = lambda xs: F.filter(xs, lambda m: ~F.exists(xs, lambda n: n.startswith(F.concat(m, F.lit(".")))))
    # each list is bound by a lambda over one element: it is made once, not again for each of its own elements
    return F.element_at(F.transform(F.transform(F.array(clean), kept), leaves), 1)


def likely_test(source: Column) -> Column:
    """Where the test of a source file is looked for first: tests/test_<stem>.py beside it; a test file is its own."""
    folder, stem = F.regexp_extract(source, r"^(.*)/[^/]*$", 1), F.regexp_replace(F.regexp_extract(source, r"([^/]*)\.py$", 1), "^_+", "")
    place = F.when(folder == "", F.lit(".")).otherwise(folder)
    return F.when(source.contains("/tests/"), source).otherwise(F.concat(place, F.lit("/tests/test_"), stem, F.lit(".py")))


def mapped_tests(sources: DataFrame, mapping: DataFrame, source: str = "source") -> DataFrame:
    """sources with modules: those of the first pattern (mapping: ord, pattern, modules) that the path holds, else its likely test. The mapping is a small table of one repository."""
    keys = F.broadcast(mapping) if mapping.limit(10_001).count() <= 10_000 else mapping
    rows = sources.select(F.struct("*").alias("__row"), F.monotonically_increasing_id().alias("__k"))
    hit = rows.join(keys, F.col(f"__row.{source}").contains(F.col("pattern")), "left")
    first = hit.groupBy("__k").agg(F.first("__row").alias("__row"), F.min_by("modules", "ord").alias("modules"))
    return first.select("__row.*", F.coalesce("modules", F.array(likely_test(F.col(f"__row.{source}")))).alias("modules"))


def image_with_commit(repo: Column, commit: Column, prefix: str) -> Column:
    """The image of a repository at a commit, by eight characters of it; null without either."""
    known = repo.contains("/") & (F.coalesce(commit, F.lit("")) != "")
    return F.when(known, F.concat(F.lit(prefix), F.substring_index(repo, "/", 1), F.lit("_1776_"), F.regexp_replace(repo, "^[^/]*/", ""), F.lit("."), F.substring(commit, 1, 8)))


def joined_patches(first: Column, second: Column) -> Column:
    """Two patches one after the other, each ending its line; either alone as it is."""
    ended = lambda p: F.when(p.endswith("\n"), p).otherwise(F.concat(p, F.lit("\n")))
    a, b = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(ended(a), ended(b)))


def disjoint_tests(fail: Column, keep: Column, spare: Column, fill: int = 5) -> Column:
    """The tests that are to stay passing without those that are to fail; if none is left, up to `fill` spare ones."""
    left = F.array_except(keep, fail)
    return F.when(F.size(left) > 0, left).otherwise(F.slice(F.array_except(spare, fail), 1, fill))


def resolved(expected: Column, passed: Column, failed: Column) -> Column:
    """Is every expected test found among the passed ones, either name holding the other? Without expected tests: did none fail?"""
    found = F.forall(expected, lambda e: F.exists(passed, lambda p: p.contains(e) | e.contains(p)))
    return F.when(F.size(expected) > 0, found).otherwise(F.size(failed) == 0)


def ranked_candidates(rows: DataFrame, mode: str = "filter") -> DataFrame:
    """seed, node, rank of candidates (seed, node, hits, related, score) by tests that hit them, related tests and score, ties by name.

    mode filter: only those with hits if a seed has any, else only those with related tests if it has any; rank_only: all; off: in the order of place, a column of rows.
    """
    w = Window.partitionBy("seed")
    out = rows
    if mode == "filter":
        best = rows.withColumn("__h", F.max("hits").over(w)).withColumn("__r", F.max("related").over(w))
        out = best.where(F.when(F.col("__h") > 0, F.col("hits") > 0).when(F.col("__r") > 0, F.col("related") > 0).otherwise(True))
    order = [F.col("place")] if mode == "off" else [F.desc("hits"), F.desc("related"), F.desc("score"), F.col("node")]
    return out.select("seed", "node", F.row_number().over(w.orderBy(*order)).alias("rank"))

"""Column functions on texts, patches, paths and scores. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row however often the body reads it, also in functions over the entries of an array."""
    return F.get(F.transform(F.array(value), body), 0)


def tokens(text: Column) -> Column:
    """White-space separated tokens; none for null."""
    return F.coalesce(F.array_remove(F.split(text, r"\s+"), ""), F.array().cast("array<string>"))


def type_token_ratio(text: Column) -> Column:
    """Distinct tokens of the lower-cased text over all tokens; 0 without tokens."""
    t = tokens(F.lower(text))
    return F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(0.0)


def is_test_file(node_id: Column) -> Column:
    """Does the path before the first colon lie in a test folder or have a test file's name?"""
    path = F.lower(F.substring_index(node_id, ":", 1))
    name = F.substring_index(path, "/", -1)
    folder = path.contains("tests/") | path.contains("test/") | path.contains("/testing/")
    return folder | name.startswith("test_") | name.endswith("_test.py") | name.endswith("_tests.py") | name.isin("tests.py", "conftest.py", "test.py")


def identifiers(code: Column, keywords: list[str]) -> Column:
    """Distinct identifiers of three characters or more that are no keywords."""
    found = F.regexp_extract_all(code, F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(k) for k in keywords]).cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def sentences(text: Column) -> Column:
    """Pieces after . ! or ? and white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def code_tokens(code: Column) -> Column:
    """How many words or single symbols a code text holds."""
    return F.regexp_count(code, F.lit(r"\w+|[^\w\s]"))


def redact(text: Column) -> Column:
    """api_key lines masked to their end, and keys that begin with sk- wherever they stand."""
    lines = F.regexp_replace(text, r"(?im)^(\s*api_key\s*:\s*)(.+)$", "$1<REDACTED>")
    return F.regexp_replace(lines, r"sk-[A-Za-z0-9_-]{10,}", "sk-<REDACTED>")


def patch_files(patch: Column) -> Column:
    """Files that a unified diff names, in order, without /dev/null."""
    return F.array_remove(F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^(?:--- a/|\+\+\+ b/)(.+)$"), F.lit(1))), "/dev/null")


def changed_lines(patch: Column) -> tuple[Column, Column]:
    """Added and removed lines of a unified diff, without the file headers."""
    lines = F.split(patch, "\n")
    added = F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++"))
    return added, F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---"))


#: Signs of sabotage in added lines.
SABOTAGE = (r"raise\s+Exception\s*\(", r"(?m)return\s+None\s*$", r"return\s+object\(\)", r'= "SABOTAGE"', r"= None\s*#", r"(?m)pass\s*$")


def patch_naturalness(patch: Column) -> Column:
    """A struct of line and hunk counts, sabotage and the score of a patch."""
    safe = F.coalesce(patch, F.lit(""))
    added, removed = changed_lines(safe)
    hunks = F.size(F.filter(F.split(safe, "\n"), lambda x: x.startswith("@@")))
    text = F.array_join(F.transform(added, lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")
    sabotage = text.rlike("(?m)" + "|".join(p.removeprefix("(?m)") for p in SABOTAGE))
    n = F.size(added) + F.size(removed)
    score = F.when(n == 0, 0.0).when(sabotage, 0.2).when((n <= 5) & (hunks == 1), 1.0).when((n <= 10) & (hunks == 1), 0.9).when(n <= 10, 0.7).when(n <= 20, 0.5).otherwise(0.3)
    return F.struct(n.alias("changed_lines"), F.size(added).alias("added_lines"), F.size(removed).alias("removed_lines"), hunks.alias("hunk_count"), (hunks == 1).alias("is_single_hunk"), sabotage.alias("sabotage_detected"), score.alias("naturalness_score"))


#: Phrases that tell how a report describes a defect, and how it gives the repair away.
BEHAVIOUR = r"(?i)\b(when|instead of|expected|returns|produces|should|fails to)\b"
ERROR_WORDS = r"(?i)\b(Error|Exception|TypeError|ValueError|AssertionError|raises|fails with|traceback)\b"
LEAKS = (r"(?i)\b(the fix is|fixed by|should be changed to|replace .+ with)\b", r"(?i)\b(use .+ instead of|change .+ to|switching from .+ to)\b", r"(?i)\b(needs to be|should use)\b")
FALLBACKS = ("Synthetic defect", "synthetic defect", "No description", "Bug injection")


def report_informativeness(text: Column) -> Column:
    """A struct of what a report tells, and its score from 0 to 1."""
    safe = F.coalesce(text, F.lit(""))
    n = F.size(tokens(safe))
    fallback = n < 10
    for phrase in FALLBACKS:
        fallback = fallback | safe.contains(phrase)
    behaves, errs = safe.rlike(BEHAVIOUR), safe.rlike(ERROR_WORDS)
    leaks = sum((safe.rlike(p).cast("int") for p in LEAKS), F.lit(0))
    raw = 0.3 + F.when(behaves, 0.3).otherwise(0.0) + F.when(errs, 0.2).otherwise(0.0) + F.when(n.between(20, 200), 0.2).when(n > 200, 0.1).otherwise(0.0) - 0.15 * leaks
    blank = n == 0
    score = F.when(fallback, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3))
    return F.struct(n.alias("token_count"), (behaves & ~blank).alias("has_behavioral_desc"), (errs & ~blank).alias("has_error_desc"), fallback.alias("is_fallback"), F.when(blank, 0).otherwise(leaks).alias("leak_count"), score.alias("info_score"))


def impact(p2f: Column, p2p: Column) -> tuple[Column, Column]:
    """The share of passing tests that break, and its score."""
    ratio = F.when(p2f + p2p > 0, p2f / (p2f + p2p)).otherwise(0.0)
    score = F.when(p2f + p2p == 0, 0.0).when(ratio < 0.001, 0.1)
    for most, value in ((0.005, 0.5), (0.03, 0.9), (0.10, 1.0), (0.15, 0.9), (0.30, 0.6), (0.50, 0.3)):
        score = score.when(ratio <= most, value)
    return ratio, score.otherwise(0.1)


def composite(failure: Column, impact_: Column, natural: Column, report: Column, alignment: Column) -> tuple[Column, Column]:
    """The composite score of a defect and its tier; a fifth of the weight is held at one half."""
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.15 * failure + 0.15 * impact_ + 0.15 * natural + 0.15 * report + 0.20 * alignment + 0.1))
    q = F.floor(raw * 1000 + 0.5) / 1000  # of the binary value: F.round would go by its shortest decimal form
    return q, F.when(q >= 0.7, "A").when(q >= 0.5, "B").when(q >= 0.3, "C").otherwise("D")


def chain_difficulty(length: Column, degrees: Column, connectivity: Column) -> tuple[Column, Column]:
    """Points from 0 to 100 for tracing a chain, and their level; degrees: mean in- plus mean out-degree."""
    by_length = F.when(length == 1, 5).when(length == 2, 10).when(length <= 4, 20).otherwise(F.least(F.lit(30), 20 + (length - 4) * 2))
    raw = by_length + F.least(F.lit(40.0), degrees * 2) + (1 - connectivity) * 30
    return F.round(F.least(F.lit(100.0), raw), 2), F.when(raw < 20, "trivial").when(raw < 40, "easy").when(raw < 60, "medium").when(raw < 80, "hard").otherwise("expert")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double precision."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def identifier_density(text: Column, ids: Column) -> Column:
    """The share of identifiers that a text holds, whatever the case; 0 without identifiers."""
    return F.when(F.size(ids) > 0, F.size(F.filter(ids, lambda x: F.lower(text).contains(F.lower(x)))) / F.size(ids)).otherwise(0.0)


def path_words(files: Column) -> Column:
    """Distinct words of three letters or more of an array of paths: parts of the stem, and every part of the path but tests."""
    def words(path: Column) -> Column:
        parts = F.filter(F.split(path, "/"), lambda x: x != "")
        stem = F.filter(F.split(F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", ""), "_"), lambda x: F.length(x) > 2)
        return F.concat(stem, F.transform(F.filter(parts, lambda x: (F.length(x) > 2) & (x != "tests")), lambda x: F.replace(x, F.lit(".py"), F.lit(""))))

    return F.array_distinct(F.flatten(F.transform(F.filter(files, lambda p: p != ""), words)))


def chain_signals(text: Column, files: Column) -> Column:
    """A struct of how many words a chain's paths have, how many of them the text holds, and their ratio (0 without any)."""
    words = path_words(files)
    found = F.size(F.filter(words, lambda x: F.lower(text).contains(F.lower(x))))
    return F.struct(F.size(words).alias("n_signals"), found.alias("n_found"), F.when(F.size(words) > 0, found / F.size(words)).otherwise(0.0).alias("ratio"))

"""What lets a seed, a patch, a test or a problem text pass, and how leaking texts are cleaned."""

from __future__ import annotations

import ast
import io
import math
import re
import textwrap
import tokenize
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import python_column
from .scalars import BEHAVIOUR, FALLBACKS, bound, changed_lines, tokens

#: Phrases that tell how to repair a defect, and subtler ones that point at it.
DIRECTIVES = (
    r"\bthe fix is\b",
    r"\bfix(?:ed)? by\b",
    r"\bshould (?:be )?(?:changed|replaced|updated|converted|switched) to\b",
    r"\breplace\s+\S+\s+with\b",
    r"\buse\s+\S+\s+instead of\b",
    r"\bshould use\b",
    r"\bneeds to be\b",
    r"\bchange\s+\S+\s+to\b",
    r"\bswitch(?:ing)?\s+from\s+\S+\s+to\b",
)
IMPLICIT = (
    r"\bin\s+(?:line|method|function)\s+\w+\s+of\s+\w+\.py\b",
    r"\b(?:missing|removed|deleted|dropped)\s+(?:the\s+)?(?:call|check|guard|wrapper|import|conversion|cast)\b",
    r"\b(?:the bug is|the issue is caused by|the root cause is|this is because)\b",
    r"\b(?:parameter|argument|variable)\s+`?\w+`?\s+(?:should be|was|is)\s+(?:removed|added|changed)\b",
    r"\b(?:was changed from|changed from|was replaced by|instead of the correct)\b",
)
#: Mentions of tests, placeholders for tests, line beginnings that are no leak, and changes that change nothing.
TEST_MENTIONS = (r"\bpytest\b", r"\btest_\w+\s+fail", r"\bexisting tests?\s+fail", r"\brunning\s+(?:the\s+)?tests?\b")
PLACEHOLDERS = ("test_reproduce_bug", "test_synthetic", "test_bug", "test_method", "TestClass", "test_example")
BOILERPLATE = ("def ", "class ", "import ", "from ", "return")
TRIVIAL = (r"^print\s*\(", r"^logging\.", r"^logger\.", r"^pass$")
FALLBACK, EXCLUDED_INTENTS, LEAST_CHAIN = "Synthetic defect", ("Complex_Logic_Rewrite",), 2


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def seed_refusal(chain_length: Column, intent: Column, before: Column, after: Column) -> Column:
    """Why a seed is not worth a synthesis, or null; chain_length: of its first chain, null without one; intent: its first, null without one."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(chain_length.isNull() | intent.isNull(), "no chain or intent")
        .when(chain_length < LEAST_CHAIN, F.format_string(f"chain too short (%d < {LEAST_CHAIN})", chain_length))
        .when(intent.isin(*EXCLUDED_INTENTS), F.concat(intent, F.lit(" is excluded")))
        .when(blank(before) | blank(after), "no code transformation")
    )


def text_refusal(text: Column, level: Column) -> Column:
    """Why a problem text is not acceptable at its level (minimal, standard, detailed, others unchecked), or null."""
    leaks = lambda safe: sum((safe.rlike("(?i)" + p).cast("int") for p in DIRECTIVES), F.lit(0))
    return bound(F.coalesce(text, F.lit("")), lambda safe: bound(F.struct(F.size(tokens(safe)).alias("n"), leaks(safe).alias("leaks")), lambda c: _text_refusal(safe, c["n"], c["leaks"], level)))


def _text_refusal(safe: Column, n: Column, leaks: Column, level: Column) -> Column:
    say = lambda s: F.format_string(s, n)
    return (
        F.when(n == 0, "empty_ps")
        .when(_any([safe.contains(p) for p in FALLBACKS]), "fallback_detected")
        .when(n < 8, say("too_short (%d tokens)"))
        .when(leaks > 0, F.format_string("fix_leak_detected (%d patterns)", leaks))
        .when((level == "minimal") & (n > 60), say("too_verbose_for_minimal (%d tokens)"))
        .when((level == "standard") & (n < 15), say("too_short_for_standard (%d tokens)"))
        .when((level == "standard") & ~safe.rlike(BEHAVIOUR), "missing_behavioral_desc_for_standard")
        .when((level == "detailed") & (n < 30), say("too_short_for_detailed (%d tokens)"))
    )


def telling_lines(before: Column, after: Column) -> Column:
    """Lines of more than 15 characters that only one of two codes has, trimmed, but for boilerplate; empty if either code is."""
    lines = lambda c: F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: F.length(x) > 15)
    both = F.array_union(F.array_except(lines(after), lines(before)), F.array_except(lines(before), lines(after)))
    kept = F.filter(both, lambda x: ~_any([x.startswith(b) for b in BOILERPLATE]))
    none = F.array().cast("array<string>")
    return F.when((F.coalesce(before, F.lit("")) != "") & (F.coalesce(after, F.lit("")) != ""), kept).otherwise(none)


def sanitized(text: Column, before: Column, after: Column) -> Column:
    """A problem text without leaks.

    Sentences with a directive, a mention of tests or an implicit leak go, lines of the patch become [CODE]. A text that has both a directive
    and a line of the patch is cut down to its first sentence, if that has 15 characters before its end and no directive; what is left without words becomes a fallback.
    """
    return bound(text, lambda text: bound(telling_lines(before, after), lambda lines: _sanitized(text, lines)))


def _sanitized(text: Column, lines: Column) -> Column:
    directed = _any([text.rlike("(?i)" + p) for p in DIRECTIVES])
    quoted = F.exists(lines, lambda x: text.contains(x))
    leaking = directed | quoted | _any([text.rlike("(?i)" + p) for p in (*TEST_MENTIONS, *IMPLICIT)])
    first = F.regexp_extract(text, r"^([^.!?\n]{15,}[.!?])", 1)
    severe = F.when((first != "") & ~_any([first.rlike("(?i)" + p) for p in DIRECTIVES]), F.regexp_replace(first, r"^\s+|\s+$", "")).otherwise(FALLBACK)
    # the first match begins where a sentence does or the last one ended, so no other place is tried: without that a sentence costs the square of its length
    sentence = lambda p: rf"(?i)(?:\G|(?<=[.!?\n]))[^.!?\n]*{p}[^.!?\n]*[.!?]?\s*"
    clean = reduce(lambda t, p: F.regexp_replace(t, sentence(p), ""), DIRECTIVES, text)
    clean = F.aggregate(lines, clean, lambda t, x: F.replace(t, x, F.lit("[CODE]")))
    clean = reduce(lambda t, p: F.regexp_replace(t, sentence(p), ""), (*TEST_MENTIONS, *IMPLICIT), clean)
    clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
    return F.when(~leaking, text).when(directed & quoted, severe).otherwise(bound(clean, lambda c: F.when(c == "", FALLBACK).otherwise(c)))


def is_disallowed(label: Column, prefixes: Column) -> Column:
    """Is a test label one of the prefixes (an array), or below one?"""
    s = F.trim(label)
    return F.coalesce(F.exists(prefixes, lambda p: (s == p) | s.startswith(F.concat(p, F.lit(".")))), F.lit(False))


def test_file_of(test: Column) -> Column:
    return F.substring_index(test, "::", 1)


def existing_tests(tests: DataFrame, files: DataFrame, test: str = "test", file: str = "file") -> DataFrame:
    """tests with valid: is the test no placeholder, and does its file exist among files(file)? Empty and null tests go."""
    known = files.select(F.col(file).alias("__file"), F.lit(True).alias("__known")).distinct()
    rows = tests.where(F.col(test) != "").withColumn("__of", test_file_of(F.col(test)))
    placeholder = _any([F.col(test).contains(p) for p in PLACEHOLDERS])
    return rows.join(known, F.col("__of") == F.col("__file"), "left").withColumn("valid", ~placeholder & F.coalesce("__known", F.lit(False))).drop("__of", "__file", "__known")


def allowed_tests(tests: DataFrame, allowed: DataFrame, key: str, test: str = "test") -> DataFrame:
    """The tests (key, test) that their key's allowed suite (key, test) names, or whose file it names; all of them for keys without a suite."""
    suite = allowed.select(key, F.trim(test).alias("__t")).where("__t <> ''").distinct()
    files = suite.where(F.col("__t").contains("::")).select(key, F.trim(test_file_of(F.col("__t"))).alias("__f")).where("__f like '%.py'").distinct()
    rows = tests.withColumns({"__t": F.trim(test), "__f": F.when(F.trim(test).contains("::"), F.trim(test_file_of(F.trim(test))))}).where("__t <> ''")
    named = rows.join(suite.withColumn("__a", F.lit(True)), [key, "__t"], "left").join(files.withColumn("__b", F.lit(True)), [key, "__f"], "left")
    judged = named.join(suite.select(key).distinct().withColumn("__has", F.lit(True)), key, "left")
    return judged.where("__has is null or __a or __b").select(*tests.columns)


def embeddable(nodes: DataFrame) -> DataFrame:
    """Classes and functions with code, without classes that have a method of their own among them; nodes: node_id, type, code."""
    kept = nodes.where("type in ('function', 'class') and trim(code) <> ''")
    methods = kept.where("type = 'function'").select(F.regexp_replace("node_id", r"\.[^.:]*$", "").alias("__owner"), "node_id").where("__owner <> node_id").select("__owner").distinct()
    owned = kept.where("type = 'class'").join(methods, F.col("node_id") == F.col("__owner"), "left_semi").select(F.col("node_id").alias("__gone"))
    return kept.join(owned, F.col("node_id") == F.col("__gone"), "left_anti")


def _comments(code: str) -> Counter:
    text = textwrap.dedent(code or "")
    try:
        return Counter(t.string.strip() for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT)
    except (tokenize.TokenError, SyntaxError):
        return Counter(x for x in map(str.strip, (code or "").splitlines()) if x.startswith("#"))


def _docstrings(code: str) -> dict[tuple[str, ...], str]:
    try:
        tree = ast.parse(textwrap.dedent(code or ""))
    except (SyntaxError, ValueError):
        return {}
    out: dict[tuple[str, ...], str] = {}
    todo: list[tuple[tuple[str, ...], ast.AST]] = [((), tree)]
    while todo:
        place, node = todo.pop()
        if isinstance(node, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            doc = ast.get_docstring(node)
            if doc is not None:
                out[place] = doc
            todo += [((*place, f"{type(x).__name__}:{x.name}"), x) for x in ast.iter_child_nodes(node) if isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
    return out


def parses(code: str | None) -> bool:
    try:
        ast.parse(textwrap.dedent(code or ""))
        return True
    except (SyntaxError, ValueError):
        return False


def valid_python(code: Column) -> Column:
    """Does a code text parse, once its common indent is taken off?"""
    return python_column(lambda codes: codes.map(parses), "boolean")(code)


def wordy_change(a: str | None, b: str | None) -> str | None:
    """'new comments' or 'docstrings changed', if the second code has them against the first."""
    if _comments(b or "") - _comments(a or ""):
        return "new comments"
    return "docstrings changed" if _docstrings(a or "") != _docstrings(b or "") else None


def patch_refusal(patch: Column, before: Column, after: Column, strict: bool = True) -> Column:
    """Why a patch changes nothing of meaning, or null. strict: new comments and changed docstrings are refused too."""
    squeeze = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    added, removed = changed_lines(F.coalesce(patch, F.lit("")))
    trimmed = lambda a: F.transform(a, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), r"^\s+|\s+$", ""))
    meaningful = lambda a: F.filter(trimmed(a), lambda x: ~x.rlike(r"^(?:$|#|\"\"\"|''')"))
    plus, minus = meaningful(added), meaningful(removed)
    real = F.filter(plus, lambda x: ~_any([x.rlike(p) for p in TRIVIAL]))
    out = F.when(F.trim(F.regexp_replace(F.coalesce(patch, F.lit("")), r"\s+", "")) == "", "empty").when((F.coalesce(after, F.lit("")) != "") & ~valid_python(after), "invalid syntax").when(squeeze(before) == squeeze(after), "white space only")
    if strict:
        wordy = python_column(lambda a, b: pd.Series([wordy_change(x, y) for x, y in zip(a, b, strict=True)], dtype=object), "string")(before, after)
        out = out.when(wordy.isNotNull(), wordy)
    return out.when((F.size(plus) == 0) & (F.size(minus) == 0), "comments only").when((F.size(real) == 0) & (F.size(minus) == 0), "trivial only")


#: What changed lines hold if they fit the kind of repair, and the score then and otherwise.
INTENT_SIGNS = {
    "Condition_Refinement": (r"(if|while|elif|and|or|not|>=|<=|>|<|==|!=|is\s+not|is\s+None)", 0.9, 0.3),
    "Guard_Clause_Addition": (r"(if\s+.*is\s+(None|not)|isinstance|assert|raise|return\s+(None|$))", 0.9, 0.3),
    "Argument_Update": (r"\([^)]*[,=][^)]*\)", 0.8, 0.3),
    "Exception_Fix": (r"(except|raise|try|finally|Exception|Error)", 0.9, 0.3),
    "API_Replacement": (r"\w+\.\w+\(", 0.7, 0.4),
}


def intent_fit(added: Column, removed: Column, intent: Column, category: Column) -> Column:
    """How well changed lines (arrays) fit the kind of repair, from 0 to 1; small changes gain, large ones lose."""
    changes, n = F.array_join(F.concat(added, removed), " "), F.size(added) + F.size(removed)
    starts = lambda p: F.coalesce(category, F.lit("")).startswith(p)
    constant = (
        F.when(starts("regex"), F.when(changes.rlike(r"[r]?[\"'][^\"']*[\$\\][^\"']*[\"']"), 0.9).when(changes.rlike(r"[r]?[\"'][^\"']+[\"']"), 0.7).otherwise(0.0))
        .when(starts("numeric"), F.when(changes.rlike(r"\d+"), 0.8).otherwise(0.0))
        .when(starts("string"), F.when(changes.rlike(r"[\"'][^\"']+[\"']"), 0.8).otherwise(0.0))
        .otherwise(F.when(changes.rlike(r"[\"'][^\"']*[\"']|\d+"), 0.6).otherwise(0.0))
    )
    score = F.when(intent == "Constant_Update", constant)
    for kind, (sign, hit, miss) in INTENT_SIGNS.items():
        score = score.when(intent == kind, F.when(changes.rlike(sign), hit).otherwise(miss))
    score = score.when(intent == "Variable_Replacement", F.when((F.size(added) > 0) & (F.size(removed) > 0), 0.6).otherwise(0.3)).otherwise(0.5)
    return F.when(n == 0, 0.0).when(n <= 10, F.least(F.lit(1.0), score + 0.1)).when(n > 20, F.greatest(F.lit(0.0), score - 0.2)).otherwise(score)


def token_entropy(text: str | None) -> float:
    """Entropy in bits of the tokens of Python code without comments and layout; of its lower-cased words if it is no Python."""
    layout = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}
    try:
        found = [t.string for t in tokenize.generate_tokens(io.StringIO(text or "").readline) if t.type not in layout and t.string.strip()]
    except (tokenize.TokenError, SyntaxError):
        found = re.findall(r"\S+", (text or "").lower())
    counts = Counter(found).values() if len(found) > 1 else ()
    return -sum(c / len(found) * math.log2(c / len(found)) for c in counts) + 0.0


def code_token_entropy(code: Column) -> Column:
    return python_column(lambda codes: codes.map(token_entropy), "double")(code)

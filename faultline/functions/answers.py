"""What models and tools answer: JSON in prose, thoughts and actions, numbered variants, snippets and patches, usage records."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import python_column
from .logs import strip
from .scalars import bound

#: The heading of a thought, an action and its input, in the ways that answers write them.
_THOUGHT, _ACTION, _INPUT = (rf"(?:{w}|### {w}|\*\*{w}:\*\*)" for w in ("Thought", "Action", "Action Input"))
#: Keys of usage records under their several names, and keys that hold none.
USAGE_NAMES = {"input_tokens": ("input_tokens", "prompt_tokens", "input", "prompt_length"), "output_tokens": ("output_tokens", "completion_tokens", "output", "response_length")}
USAGE_SKIPS = ("system_prompt", "code_before", "code_after", "fail_to_pass_code", "prompt", "response")
USAGE = "array<struct<model:string,input_tokens:bigint,output_tokens:bigint,cache_write:bigint,cache_read:bigint,timestamp:string>>"


def tolerant_list(value: Column) -> Column:
    """A list given as JSON text, or a bare text as its only entry; nulls and empty texts give none."""
    t = F.trim(value)
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(t, F.lit("")) == "", none).when(t.startswith("["), F.coalesce(F.filter(F.from_json(t, "array<string>"), lambda x: x.isNotNull()), F.array(t))).otherwise(F.array(t))


def is_json(text: Column) -> Column:
    """Is a text a JSON object? What follows its first value is not looked at by the parser, so the text must also end in a brace."""
    return F.try_parse_json(text).isNotNull() & text.rlike(r"\}\s*\z")


def repaired(text: Column) -> Column:
    """A JSON text in which backslashes that escape nothing are doubled."""
    return F.regexp_replace(text, r'(?<!\\)\\(?![nrtbf"\\/u])', r"\\\\")


def json_in(answer: Column) -> Column:
    """The JSON object in an answer: without a code fence, from the first brace to the last, its backslashes repaired if need be; null if none parses."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"(?s)^.*?```(?:json)?\s*(?=\{)", ""), r"(?s)```.*$", "")
    inner = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(is_json(inner), inner).when(is_json(repaired(inner)), repaired(inner))


def json_by_ladder(answer: Column) -> Column:
    """The JSON object of an answer: in a fence, else all of it, else its first flat object; null if none parses."""
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    flat = F.nullif(F.regexp_extract(answer, r"(\{[^{}]*\})", 1), F.lit(""))
    return F.coalesce(*[F.when(is_json(x), x) for x in (fenced, F.trim(answer), flat)])


def longest_json(text: Column) -> Column:
    """The longest beginning of a text that ends in a brace and is JSON once its backslashes are repaired; null if there is none."""
    parts = F.split(text, r"(?<=\})")
    starts = F.transform(parts, lambda x, i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), ""))
    return F.get(F.filter(F.transform(starts, lambda x: repaired(strip(x))), lambda x: x.startswith("{") & is_json(x)), 0)


def agent_turn(answer: Column) -> Column:
    """A struct of thought, action and input (JSON text, null if none parses): from tags, else from headings; the last input that parses counts."""
    tag = lambda name: strip(F.regexp_extract(answer, rf"(?is)<{name}>(.*?)</{name}>", 1))
    stop = rf"(?:{_ACTION}|<action>)"
    headed = strip(F.regexp_extract(answer, rf"(?is){_THOUGHT}:\s*(.+?)(?={stop}|\z)", 1))
    before = strip(F.get(F.split(answer, f"(?i){stop}"), 0))
    some = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
    action = some(tag("action"), F.regexp_extract(answer, rf"(?i){_ACTION}:\s*(\w+)", 1), F.regexp_extract(answer, r"(?i)<action>:?\s*(\w+)", 1))
    to_brace = lambda p: F.transform(F.regexp_extract_all(answer, F.lit(p), F.lit(1)), lambda x: F.regexp_extract(x, r"(?s)^(.*\})", 1))
    inputs = F.concat(F.array(tag("action_input")), F.regexp_extract_all(answer, F.lit(r"```(?:json)?\s*(\{[\s\S]*?\})\s*```"), F.lit(1)), to_brace(rf"(?i){_INPUT}:\s*(\{{[\s\S]*)"), to_brace(r"(?i)<action_input>:?\s*(\{[\s\S]*)"))
    parsed = F.filter(F.transform(F.reverse(F.filter(inputs, lambda x: x != "")), longest_json), lambda x: x.isNotNull())
    return F.struct(some(tag("thought"), headed, before).alias("thought"), action.alias("action"), F.get(parsed, 0).alias("input"))


def variants(answer: Column) -> Column:
    """array<struct<number, text>> of the numbered variants of an answer, the first of each number; parts are cut at rules of dashes, else at headings."""
    parts = F.when(answer.contains("-----------"), F.split(answer, "-----------")).otherwise(F.split(answer, r"\n(?=\*\*Transform Kind \d+\*\*)"))
    head = r"(?s)\*\*Transform Kind (\d+)\*\*\s*(.+?)\s*(?:```)?\s*$"
    found = F.filter(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, head, 1).alias("number"), strip(F.regexp_extract(p, head, 2)).alias("text"))), lambda x: (x["number"] != "") & (x["text"] != ""))
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: y["number"] == x["number"]))


def unittest_id(test: Column) -> Column:
    """A struct of module, class and method of 'method (module.Class)'; null for other texts."""
    p = r"^(\S+)\s+\(([^)]+)\.([^).]+)\)$"
    return F.when(test.rlike(p), F.struct(F.regexp_extract(test, p, 2).alias("module"), F.regexp_extract(test, p, 3).alias("class"), F.regexp_extract(test, p, 1).alias("method")))


def without_line_numbers(code: Column) -> Column:
    """Code without '12 | ' before its lines, white space behind them, and around it."""
    return strip(F.regexp_replace(F.regexp_replace(code, r"(?m)^[ \t]*\d+[ \t]*\|[ \t]*", ""), r"(?m)[ \t\r]+$", ""))


def locate(snippet: Column, content: Column, hint: Column | None = None) -> Column:
    """The line at which a snippet begins in a content, white space apart; null if fewer than 60 % of its lines are found.

    A line counts 1 if it is equal and 0.5 if one holds the other. The first place with all lines is taken, those near the hint first, else the first of the best.
    """
    squeeze = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"\s+", ""))
    wanted = F.filter(squeeze(F.split(snippet, r"\r?\n")), lambda x: x != "")
    lines = squeeze(F.split(content, r"\r?\n"))
    at = F.lit(0) if hint is None else hint
    return bound(wanted, lambda wanted: bound(lines, lambda lines: bound(at, lambda at: _located(wanted, lines, None if hint is None else at))))


def _located(wanted: Column, lines: Column, hint: Column | None) -> Column:
    n, total = F.size(wanted), F.size(lines)

    def score(i: Column) -> Column:
        both = F.zip_with(wanted, F.slice(lines, i + 1, n), lambda a, b: F.when(b.isNull() | a.isNull(), 0.0).when(a == b, 1.0).when(b.contains(a) | a.contains(b), 0.5).otherwise(0.0))
        return F.aggregate(both, F.lit(0.0), lambda s, v: s + v)

    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    places = upto(F.lit(0), total - n + 1)
    if hint is not None:
        near = upto(F.greatest(F.lit(0), hint - 11), F.least(total, hint + 9))
        places = F.when(hint > 0, F.concat(near, places)).otherwise(places)
    scored = F.transform(places, lambda i: F.struct(score(i).alias("s"), i.alias("i")))

    def chosen(scored: Column) -> Column:
        whole = F.get(F.filter(scored, lambda x: x["s"] >= n - 0.1), 0)
        first = lambda top: F.when((top > 0) & (top / n >= 0.6), F.get(F.filter(scored, lambda x: x["s"] == top), 0)["i"] + 1)
        return F.coalesce(whole["i"] + 1, bound(F.array_max(F.transform(scored, lambda x: x["s"])), first))

    return F.when(n == 0, F.lit(None).cast("int")).otherwise(bound(scored, chosen))


def unified_patch(path: str, content: str | None, before: str, after: str, start: int) -> str:
    """A patch in git's form that puts `after` in the place of `before`, which begins at line `start` of the content; three lines of context; empty if nothing changes."""
    whole = lambda t: t if t.endswith("\n") else t + "\n"
    old, new, first = whole(before).splitlines(True), whole(after).splitlines(True), start
    if content is not None:
        lines, last = content.splitlines(True), start + len(old) - 1
        first = max(1, start - 3)
        tail = lines[last : last + 3]
        old, new = lines[first - 1 : last] + tail, lines[first - 1 : start - 1] + new + tail
    out = []
    for line in list(difflib.unified_diff(old, new, n=3))[2:]:
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)
        if m:
            at = first + int(m[1]) - 1
            line = f"@@ -{at},{m[2] or 1} +{at},{m[4] or 1} @@\n"
        out.append(line if line.endswith("\n") else line + "\n")
    return "".join([f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n", *out]) if out else ""


def built_patch(path: Column, content: Column, before: Column, after: Column, start: Column) -> Column:
    """unified_patch as a column."""
    return python_column(lambda p, c, b, a, s: pd.Series([unified_patch(*row) for row in zip(p, c, b, a, s, strict=True)], dtype=object), "string")(path, content, before, after, start)


def usage_records(value: object) -> list[dict]:
    """The usage records anywhere in a JSON value: objects with a model and a number of input tokens under any of their names."""
    out, todo = [], [value]
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = [*x, *todo]
        elif isinstance(x, dict):
            if "model" in x and any(k in x for k in USAGE_NAMES["input_tokens"]):
                pick = {name: next((x[k] for k in keys if isinstance(x.get(k), int)), None) for name, keys in USAGE_NAMES.items()}
                if pick["input_tokens"] is not None:
                    cache = [x.get(a) or x.get(b) or 0 for a, b in (("cache_creation_input_tokens", "cache_write_tokens"), ("cache_read_input_tokens", "cache_hit_tokens"))]
                    out.append({"model": str(x["model"]), "input_tokens": pick["input_tokens"], "output_tokens": pick["output_tokens"] or 0, "cache_write": cache[0], "cache_read": cache[1], "timestamp": str(x.get("timestamp", ""))})
            else:
                todo = [v for k, v in x.items() if k not in USAGE_SKIPS] + todo
    return out


def usage_of(text: Column) -> Column:
    """usage_records of JSON texts; none of a text that does not parse."""

    def one(t: str | None) -> list[dict]:
        try:
            return usage_records(json.loads(t or ""))
        except ValueError:
            return []

    return python_column(lambda texts: texts.map(one), USAGE)(text)

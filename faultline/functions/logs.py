"""Test logs: statuses of tests, the part between markers, kinds of failure, traceback frames and summaries.

Everything is built from column expressions; a log's lines become rows where a status depends on lines before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import bound

#: Statuses, the words that unit tests use for them, and the parsers by the name of a framework.
STATUSES = ("PASSED", "FAILED", "SKIPPED", "ERROR", "XFAIL", "XPASS")
UNIT_WORDS = {"ok": "PASSED", "passed": "PASSED", "fail": "FAILED", "failed": "FAILED", "error": "ERROR", "skipped": "SKIPPED"}
PARSERS = {"pytest": "verbose", "python": "plain", "unittest": "unit", "sympy_bin_test": "runner"}
#: What a run writes around its output, and when it could not run.
START, END = ">>>>> Start Test Output", ">>>>> End Test Output"
BROKEN = ("APPLY_PATCH_FAIL", ">>>>> Tests Timed Out")
#: How telling each kind of exception is; others count 0.5.
FAILURE_SCORES = {
    "AssertionError": 1.0,
    "ValueError": 0.8,
    "KeyError": 0.8,
    "IndexError": 0.8,
    "AttributeError": 0.7,
    "TypeError": 0.6,
    "RuntimeError": 0.6,
    "NotImplementedError": 0.5,
    "PermissionError": 0.5,
    "FileNotFoundError": 0.5,
    "OSError": 0.5,
    "NameError": 0.3,
    "ImportError": 0.2,
    "ModuleNotFoundError": 0.2,
    "SyntaxError": 0.1,
    "IndentationError": 0.1,
}
#: Where frames of other people's code lie.
LIBRARIES = ("/usr/lib/", "/site-packages/", "unittest/", "pytest/")
_FRAME = r'File "([^"]+)", line (\d+), in (\w+)\n\s+(.+)'
_TRACE = r"(?ms)(Traceback \(most recent call last\):.*?^([A-Z]\w*(?:Error|Exception)[^\n]*))"
_STRIP = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def test_statuses(logs: DataFrame, key: str, framework: str, log: str) -> DataFrame:
    """key, test and status: the last status of each test in each log (one a key); framework picks the parser, unknown ones the plain one.

    A log without a recognised line, or a null one, gives no rows.
    """
    kind = F.coalesce(*[F.when(F.col(framework) == k, F.lit(v)) for k, v in PARSERS.items()], F.lit("plain"))
    lines = logs.select(F.col(key), kind.alias("kind"), F.posexplode(F.split(log, "\n")).alias("pos", "raw")).withColumn("line", strip(F.col("raw")))
    part = lambda p, k: F.regexp_extract("line", p, k)
    plain, verbose = rf"^(\S+)\s+({'|'.join(STATUSES)})", r"^(\S+)\s+(PASSED|FAILED|ERROR|SKIPPED)\s+\[\d+%\]"
    header, body = r"(_*) (.*)\.py:(.*) (_*)", F.regexp_extract("line", r"^\S+", 0)
    simple = lines.where("kind in ('plain', 'verbose')").select(key, "pos", F.when(F.col("kind") == "plain", part(plain, 1)).otherwise(part(verbose, 1)).alias("test"), F.when(F.col("kind") == "plain", part(plain, 2)).otherwise(part(verbose, 2)).alias("status"))
    head = F.regexp_extract("raw", header, 2)
    runner = lines.where("kind = 'runner'")
    # failure headers count before all lines of tests
    headers = runner.where(F.col("raw").rlike(header)).select(key, (F.col("pos") - (1 << 30)).alias("pos"), F.concat(head, F.lit(".py:"), F.regexp_extract("raw", header, 3)).alias("test"), F.lit("FAILED").alias("status"))
    ends = F.when(F.col("line").endswith(" E"), "ERROR").when(F.col("line").endswith(" F"), "FAILED").when(F.col("line").endswith(" ok"), "PASSED")
    marks = runner.where(F.col("line").startswith("test_")).select(key, "pos", body.alias("test"), ends.alias("status"))
    found = simple.unionByName(headers).unionByName(marks).unionByName(_unit(lines.where("kind = 'unit'"), key))
    return found.where("status <> '' and test is not null").groupBy(key, "test").agg(F.max_by("status", "pos").alias("status"))


def _unit(lines: DataFrame, key: str) -> DataFrame:
    """key, pos, test, status of unit tests: a name before ' ... ', and the first status word after it, on that line or alone on a later one."""
    heads = F.col("line").contains(" ... ")
    name, rest = F.substring_index("line", " ... ", 1), F.when(heads, F.expr("substring(line, instr(line, ' ... ') + 5)")).otherwise(F.col("line"))
    word = F.lower(F.regexp_extract(F.trim(rest), r"^\S+", 0))
    status = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in UNIT_WORDS.items()])
    marked = lines.select(key, "pos", F.when(heads, strip(name)).alias("test"), status.alias("status"), heads.cast("int").alias("head"))
    group = F.sum("head").over(Window.partitionBy(key).orderBy("pos"))
    first = marked.withColumn("group", group).where("group > 0").groupBy(key, "group").agg(F.first("test", True).alias("test"), F.min_by("pos", F.when(F.col("status").isNotNull(), F.col("pos"))).alias("pos"), F.min_by("status", F.when(F.col("status").isNotNull(), F.col("pos"))).alias("status"))
    return first.select(key, "pos", "test", "status")


def marked_output(content: Column) -> Column:
    """A struct of the output between the markers and whether it is whole.

    Null if the run did not start or timed out; the raw content, not whole, without both markers; null and not whole
    if the markers stand in the wrong order.
    """
    start, end = (F.lit(f"+ : '{m}'") for m in (START, END))
    at, to = F.instr(content, f"+ : '{START}'"), F.instr(content, f"+ : '{END}'")
    broken = content.isNull() | content.contains(BROKEN[0]) | content.contains(BROKEN[1])
    bare = ~content.contains(START) | ~content.contains(END)
    inside = F.substring(content, at + F.length(start), to - at - F.length(start))
    ordered = (at > 0) & (to > at)
    return F.when(broken, F.struct(F.lit(None).cast("string").alias("output"), F.lit(False).alias("whole"))).when(bare, F.struct(content.alias("output"), F.lit(False).alias("whole"))).when(ordered, F.struct(inside.alias("output"), F.lit(True).alias("whole"))).otherwise(F.struct(F.lit(None).cast("string").alias("output"), F.lit(False).alias("whole")))


def most_common(values: Column) -> Column:
    """The most frequent entry of an array, the first of those that are equally frequent; null of an empty one."""
    ranked = lambda all_: F.transform(F.array_distinct(all_), lambda x, i: F.struct(F.size(F.filter(all_, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(bound(values, ranked))["x"]


def failure_mode(output: Column) -> Column:
    """A struct of the main kind of exception in a test output and how telling it is."""
    row = lambda m, s: F.struct(m.alias("failure_mode"), s.alias("score"))

    def common(every: Column) -> Column:
        return most_common(bound(F.filter(every, lambda x: x != "Exception"), lambda specific: F.when(F.size(specific) > 0, specific).otherwise(every)))

    def scored(mode: Column) -> Column:
        score = F.coalesce(*[F.when(mode == k, F.lit(v)) for k, v in FAILURE_SCORES.items()], F.lit(0.5))
        return F.when(mode.isNull(), row(F.lit("unknown"), F.lit(0.5))).otherwise(row(mode, score))

    def judged(output: Column) -> Column:
        every = F.concat(*[F.regexp_extract_all(output, F.lit(p), F.lit(1)) for p in (r"(?m)^([A-Z]\w*(?:Error|Exception))\s*(?:[:(\[]|$)", r"(?m)^E\s+([A-Z]\w*(?:Error|Exception))\s*[:(\[]", r"raise\s+([A-Z]\w*(?:Error|Exception))")])
        dead = output.contains("command not found") & (F.length(output) < 2000)
        return F.when(output.isNull(), row(F.lit("unknown"), F.lit(0.5))).when(dead, row(F.lit("test_broken"), F.lit(0.0))).otherwise(bound(bound(every, common), scored))

    return bound(output, judged)


def frames(section: Column) -> Column:
    """array<struct<file_path, line, function, code>> of a piece of a log."""
    group = lambda x, k: F.regexp_extract(x, _FRAME, k)
    found = F.regexp_extract_all(section, F.lit(_FRAME), F.lit(0))
    return F.coalesce(F.transform(found, lambda x: F.struct(group(x, 1).alias("file_path"), group(x, 2).cast("long").alias("line"), group(x, 3).alias("function"), strip(group(x, 4)).alias("code"))), F.expr("cast(array() as array<struct<file_path:string,line:bigint,function:string,code:string>>)"))


def traceback_of(output: Column, test: Column) -> Column:
    """The frames of a failed test: of its block in the log, else of the first traceback, else of all the log without library code."""
    name = F.concat(F.lit(r"\Q"), test, F.lit(r"\E"))
    patterns = (
        F.concat(F.lit(r"(?is)={60,}\n(?:FAIL|ERROR): .*?"), name, F.lit(r".*?\n-{60,}\n(.*?)(?=={60,}|\z)")),
        F.concat(F.lit("(?is)_{10,} "), name, F.lit(r" _{10,}\n(.*?)(?=_{10,}|\z)")),
        F.lit(r"(?is)Traceback \(most recent call last\):\n(.*?)(?:AssertionError|Exception|Error).*"),
    )
    tries = [frames(F.call_function("regexp_extract", output, p, F.lit(1))) for p in patterns]
    own = lambda x: ~F.exists(F.array(*[F.lit(s) for s in LIBRARIES]), lambda s: x["file_path"].contains(s))
    tries.append(F.filter(frames(output), own))
    return F.coalesce(*[bound(t, lambda found: F.when(F.size(found) > 0, found)) for t in tries])


def traceback_summary(output: Column) -> Column:
    """A struct of the first exception, assertion messages (300 characters and ...) and the modules of failed tests."""
    safe = F.coalesce(output, F.lit(""))
    line = strip(F.regexp_extract(safe, _TRACE, 2))
    messages = F.transform(F.regexp_extract_all(safe, F.lit(r"(?m)^(Assertion(?:Error)?:?\s*.+?)$"), F.lit(1)), strip)
    modules = F.transform(F.regexp_extract_all(safe, F.lit(r"(?m)^(?:FAIL|ERROR): \w+ \((\S+)\)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\.[^.]*$", ""))
    return F.struct(
        strip(F.substring_index(line, ":", 1)).alias("exception_type"),
        F.when(line.contains(":"), strip(F.regexp_replace(line, "^[^:]*:", ""))).otherwise("").alias("exception_message"),
        F.transform(messages, lambda m: F.when(F.length(m) > 300, F.concat(F.substring(m, 1, 300), F.lit("..."))).otherwise(m)).alias("assertion_messages"),
        F.array_sort(F.array_distinct(modules)).alias("affected_modules"),
        (line != "").alias("has_traceback"),
    )


def parsed_output(output: Column) -> Column:
    """A struct of all that a unit-test output tells: failing tests, tracebacks, messages, exception types, modules, files and totals."""
    return bound(F.coalesce(output, F.lit("")), _parsed)


def _parsed(safe: Column) -> Column:
    all_ = lambda p, k: F.regexp_extract_all(safe, F.lit(p), F.lit(k))
    header = r"(?m)^(FAIL|ERROR): (\S+) \(([^)]+)\)(?:\s*\n(.+))?"
    part, module = (lambda x, k: F.regexp_extract(x, header, k)), lambda x: F.regexp_replace(x, r"\.[^.]*$", "")
    # a match holds all that its groups need, so they are taken from it
    tests = F.transform(all_(header, 0), lambda x: F.struct(part(x, 1).alias("type"), part(x, 2).alias("method"), part(x, 3).alias("class"), module(part(x, 3)).alias("module"), strip(part(x, 4)).alias("description")))
    traces = F.transform(all_(_TRACE, 1), lambda x: F.struct(strip(x).alias("full"), strip(F.regexp_extract(x, _TRACE, 2)).alias("exception")))
    messages = F.transform(all_(r"(?m)^(Assertion(?:Error)?:?\s*.+?)$", 1), strip)
    result = F.regexp_extract(safe, r"FAILED \(([^)]+)\)", 1)
    count = lambda result, k: F.coalesce(F.nullif(F.regexp_extract(result, rf"(?:^|,)\s*{k}=(\d+)", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    whole = lambda tests, traces, result: F.struct(
        tests.alias("failing_tests"),
        traces.alias("tracebacks"),
        F.transform(messages, lambda m: F.when(F.length(m) > 500, F.concat(F.substring(m, 1, 500), F.lit("..."))).otherwise(m)).alias("assertion_messages"),
        F.array_distinct(F.transform(traces, lambda x: strip(F.substring_index(F.substring_index(x["exception"], ":", 1), "(", 1)))).alias("exception_types"),
        F.array_sort(F.array_distinct(F.transform(tests, lambda x: x["module"]))).alias("test_modules"),
        F.array_sort(F.array_distinct(F.transform(all_(r'File "(/testbed/(?!tests/)[^"]+)", line (\d+), in (\w+)', 1), lambda x: F.replace(x, F.lit("/testbed/"), F.lit(""))))).alias("source_files"),
        F.coalesce(F.nullif(F.regexp_extract(safe, r"Ran (\d+) tests? in ([\d.]+)s", 1), F.lit("")).cast("long"), F.lit(0).cast("long")).alias("total_tests"),
        count(result, "failures").alias("total_failures"),
        count(result, "errors").alias("total_errors"),
    )
    return bound(tests, lambda t: bound(traces, lambda r: bound(result, lambda s: whole(t, r, s))))

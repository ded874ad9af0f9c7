"""Queries on test logs: the events of a user are the lines of a log, and users take turns in how they test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs, scalars
from .fixtures import spread, table
from .registry import query

#: The framework of a user's log, and the line of an event in it, as expressions that both engines read.
FRAMEWORK = "CASE user_id % 5 WHEN 0 THEN 'pytest' WHEN 1 THEN 'python' WHEN 2 THEN 'unittest' WHEN 3 THEN 'sympy_bin_test' ELSE 'other' END"
_N = "CAST(floor(value) AS BIGINT)"
_PYTEST = f"""concat(CASE WHEN event_id % 7 = 0 THEN '   ' ELSE '' END, 'tests/', event_type, '/test_m', user_id % 9, '.py::T', {_N} % 5, '::test_', {_N} % 23, CASE WHEN event_id % 11 = 0 THEN chr(9) ELSE '  ' END,
  CASE event_id % 8 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'SKIPPED' WHEN 3 THEN 'XFAIL' WHEN 4 THEN 'XPASS' WHEN 5 THEN 'ok then' ELSE 'PASSED' END, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE concat(' [ ', {_N} % 90 + 10, '%] [', {_N} % 90 + 10, '%]') END)"""
_VERBOSE = "replace(" + _PYTEST + ", ' [ ', ' [')"
_UNIT = f"""CASE event_type WHEN 'click' THEN concat('test_', {_N} % 19, ' (pkg.m', user_id % 4, '.Case) ... ', CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'skipped ''no db''' ELSE 'ERROR' END)
  WHEN 'error' THEN concat('test_', {_N} % 19, ' (pkg.m', user_id % 4, '.Case) ... Testing against ', event_id, ' parts') WHEN 'view' THEN concat(' ok', CASE WHEN event_id % 2 = 0 THEN ' (1 s)' ELSE '' END) WHEN 'signup' THEN 'FAILED to set up' ELSE concat('Creating table ', event_id) END"""
_RUNNER = f"""CASE event_type WHEN 'click' THEN concat('test_', event_type, {_N} % 19, CASE event_id % 4 WHEN 0 THEN ' ok' WHEN 1 THEN '  F' WHEN 2 THEN ' E' ELSE ' f' END) WHEN 'error' THEN concat('______ sym/core/test_', user_id % 3, '.py:test_click', {_N} % 19, ' ______') WHEN 'view' THEN concat('test_click', {_N} % 19, '[slow] ok') ELSE concat('noise ', {_N}) END"""
LINE = f"CASE user_id % 5 WHEN 0 THEN {_VERBOSE} WHEN 2 THEN {_UNIT} WHEN 3 THEN {_RUNNER} ELSE {_PYTEST} END"


def log_table(spark, d):
    """user_id, framework, log."""
    lines = table(spark, d, "events").select("user_id", F.expr(FRAMEWORK).alias("framework"), "event_id", F.expr(LINE).alias("line"))
    logged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("user_id", "framework").agg(logged.alias("log"))


_LINES = rf"lines AS (SELECT user_id, {FRAMEWORK} AS framework, event_id, {LINE} AS raw, regexp_replace({LINE}, '^\s+|\s+$', '', 'g') AS line FROM events)"


@query(rf"""WITH {_LINES}, unit AS (SELECT user_id, event_id, line, contains(line, ' ... ') AS head, lower(regexp_extract(CASE WHEN contains(line, ' ... ') THEN substr(line, instr(line, ' ... ') + 5) ELSE line END, '^\s*(\S+)', 1)) AS word FROM lines WHERE framework = 'unittest'),
unit_open AS (SELECT *, max(CASE WHEN head THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM unit),
unit_done AS (SELECT o.user_id, o.event_id, h.line AS head_line, o.word, row_number() OVER (PARTITION BY o.user_id, o.since ORDER BY o.event_id) AS k FROM unit_open o JOIN unit h ON h.event_id = o.since WHERE o.word IN ('ok', 'passed', 'fail', 'failed', 'error', 'skipped')),
found AS (SELECT user_id, event_id AS place, regexp_extract(line, '^(\S+)\s+\S', 1) AS test, regexp_extract(line, '^\S+\s+(PASSED|FAILED|SKIPPED|ERROR|XFAIL|XPASS)', 1) AS status FROM lines WHERE framework IN ('python', 'other')
  UNION ALL SELECT user_id, event_id, regexp_extract(line, '^(\S+)', 1), regexp_extract(line, '^\S+\s+(PASSED|FAILED|ERROR|SKIPPED)\s+\[[0-9]+%\]', 1) FROM lines WHERE framework = 'pytest'
  UNION ALL SELECT user_id, event_id, regexp_replace(string_split(head_line, ' ... ')[1], '^\s+|\s+$', '', 'g'), CASE word WHEN 'ok' THEN 'PASSED' WHEN 'passed' THEN 'PASSED' WHEN 'fail' THEN 'FAILED' WHEN 'failed' THEN 'FAILED' WHEN 'error' THEN 'ERROR' ELSE 'SKIPPED' END FROM unit_done WHERE k = 1
  UNION ALL SELECT user_id, -1, regexp_extract(raw, '_* (.*\.py:.*) _*', 1), 'FAILED' FROM lines WHERE framework = 'sympy_bin_test' AND regexp_matches(raw, '_* .*\.py:.* _*')
  UNION ALL SELECT user_id, event_id, string_split(line, ' ')[1], CASE WHEN line LIKE '% E' THEN 'ERROR' WHEN line LIKE '% F' THEN 'FAILED' WHEN line LIKE '% ok' THEN 'PASSED' ELSE '' END FROM lines WHERE framework = 'sympy_bin_test' AND line LIKE 'test\_%' ESCAPE '\')
SELECT user_id, test, arg_max(status, place) AS status FROM found WHERE status <> '' GROUP BY ALL""")
def test_statuses(spark, d):
    """Four kinds of logs, the last status of a test wins, statuses on later lines belong to the test before."""
    return logs.test_statuses(log_table(spark, d), "user_id", "framework", "log")


_OUTPUT = """CASE user_id % 6 WHEN 0 THEN concat('setup', chr(10), 'APPLY_PATCH_FAIL ', event_id) WHEN 1 THEN concat('late', chr(10), '>>>>> Tests Timed Out ', event_id) WHEN 2 THEN concat('no marks ', event_type, event_id)
  WHEN 3 THEN concat('x', chr(10), '+ : ''>>>>> End Test Output''', event_id, '+ : ''>>>>> Start Test Output''') ELSE concat('x', chr(10), '+ : ''>>>>> Start Test Output''', chr(10), event_type, ' ', CAST(floor(value) AS BIGINT), chr(10), '+ : ''>>>>> End Test Output''', chr(10), 'tail') END"""


@query("""SELECT event_id, CASE WHEN user_id % 6 = 2 THEN concat('no marks ', event_type, event_id) WHEN user_id % 6 > 3 THEN concat(chr(10), event_type, ' ', CAST(floor(value) AS BIGINT), chr(10)) END AS output, user_id % 6 > 3 AS whole FROM events""")
def marked_outputs(spark, d):
    """the output between markers, with the flags of runs that failed, timed out or lack a marker."""
    return table(spark, d, "events").select("event_id", logs.marked_output(F.expr(_OUTPUT)).alias("o")).select("event_id", "o.output", "o.whole")


_ERRORS = "CASE {x} % 7 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError' WHEN 2 THEN 'AssertionError' WHEN 3 THEN 'Exception' WHEN 4 THEN 'OddError' WHEN 5 THEN 'TypeError' ELSE 'ImportError' END"
_E1, _E2, _E3 = (_ERRORS.format(x=x) for x in ("o_custkey", "CAST(floor(o_totalprice) AS BIGINT)", "o_orderkey"))
_FAILURE = f"""CASE WHEN o_orderkey % 13 = 0 THEN 'bash: pytest: command not found' WHEN o_orderkey % 13 = 1 THEN concat('all ', o_orderstatus, ' fine') ELSE concat('tests run', chr(10), {_E1}, ': bad ', o_custkey, chr(10), 'E   ', {_E2}, ': ', o_orderpriority, chr(10), '    raise ', {_E3}, '(x)', CASE WHEN o_orderstatus = 'O' THEN concat(chr(10), {_E1}, '(again)') ELSE '' END) END"""


@query(f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN [{_E1}, {_E1}, {_E2}, {_E3}] ELSE [{_E1}, {_E2}, {_E3}] END AS e FROM orders),
p AS (SELECT * FROM (SELECT o_orderkey, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM o) WHERE x <> 'Exception'),
c AS (SELECT o_orderkey, x, count(*) AS n, min(i) AS i FROM p GROUP BY ALL), m AS (SELECT o_orderkey, arg_min(x, (-n, i)) AS mode FROM c GROUP BY 1),
k AS (SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 'test_broken' WHEN 1 THEN 'unknown' ELSE coalesce(mode, 'unknown') END AS failure_mode FROM orders LEFT JOIN m USING (o_orderkey))
SELECT o_orderkey, failure_mode, CASE failure_mode WHEN 'AssertionError' THEN 1.0 WHEN 'ValueError' THEN 0.8 WHEN 'KeyError' THEN 0.8 WHEN 'TypeError' THEN 0.6 WHEN 'ImportError' THEN 0.2 WHEN 'test_broken' THEN 0.0 ELSE 0.5 END::DOUBLE AS score FROM k""")
def failure_modes(spark, d):
    """the main kind of exception of an output, generic ones last, and its score."""
    return spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", logs.failure_mode(F.expr(_FAILURE)).alias("m")).select("o_orderkey", "m.failure_mode", "m.score")


#: A run's log: two failed tests, each with a traceback through the lines of an order.
_BLOCK = "concat(repeat('=', 70), chr(10), {kind}, ': test_', o_orderkey, {n}, ' (pkg.mod', o_custkey % 50, '.Case', o_custkey % 3, ')', chr(10), {doc}, repeat('-', 70), chr(10), 'Traceback (most recent call last):', chr(10), {frames}, chr(10), {error}, ': ', o_orderpriority, ' != ', o_orderstatus, chr(10), chr(10))"


def _outputs(spark, d):
    """o_orderkey, output: the log of a run with a block for each of two tests."""
    li = table(spark, d, "lineitem")
    frame = F.expr("concat('  File \"/testbed/', CASE WHEN l_linenumber = 1 THEN 'tests/t' ELSE 'src/m' END, l_suppkey, '.py\", line ', l_partkey, ', in fn_', CAST(l_quantity AS BIGINT), chr(10), '    call(', l_linenumber, ')')")
    stack = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", frame.alias("x")))), lambda x: x["x"]), "\n")
    stacks = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(stack.alias("stack"))
    block = lambda kind, n, doc, frames, error: F.expr(_BLOCK.format(kind=kind, n=n, doc=doc, frames=frames, error=error))
    own = "concat('  File \"/testbed/tests/a.py\", line 7, in test_', o_orderkey, chr(10), '    check()')"
    text = F.concat(F.lit("Ran setup\n"), block("'FAIL'", "'a'", "concat('About ', o_orderpriority, chr(10))", "stack", "'AssertionError'"), block("'ERROR'", "'b'", "''", own, "'KeyError'"), F.expr("concat('Ran ', o_custkey % 90 + 2, ' tests in 0.', o_custkey % 10, 's', chr(10), 'FAILED (failures=', o_custkey % 4, CASE WHEN o_custkey % 3 = 0 THEN concat(', errors=', o_custkey % 7) ELSE '' END, ')')"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").join(stacks, "o_orderkey").select("o_orderkey", text.alias("output"))


@query("""SELECT l_orderkey AS o_orderkey, 'a' AS test, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, x, 'fn_' || CAST(l_quantity AS BIGINT)) - 1 AS pos, '/testbed/' || x AS file_path, l_partkey AS line, 'fn_' || CAST(l_quantity AS BIGINT) AS function, 'call(' || l_linenumber || ')' AS code FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 'tests/t' ELSE 'src/m' END || l_suppkey || '.py' AS x FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT o_orderkey, 'b', 0, '/testbed/tests/a.py', 7, 'test_' || o_orderkey, 'check()' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def traceback_frames(spark, d):
    """The frames of each failed test from its own block of the log."""
    tests = _outputs(spark, d).select("o_orderkey", "output", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("test"))
    found = tests.select("o_orderkey", "test", F.posexplode(logs.traceback_of(F.col("output"), F.concat(F.lit("test_"), "o_orderkey", "test"))).alias("pos", "f"))
    return found.select("o_orderkey", "test", "pos", "f.file_path", "f.line", "f.function", "f.code")


@query("""SELECT o_orderkey, 'AssertionError' AS exception_type, o_orderpriority || ' != ' || o_orderstatus AS exception_message, ['AssertionError: ' || o_orderpriority || ' != ' || o_orderstatus] AS assertion_messages, ['pkg.mod' || o_custkey % 50] AS affected_modules, true AS has_traceback FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def traceback_summaries(spark, d):
    """the first exception, assertion messages and affected modules."""
    return _outputs(spark, d).select("o_orderkey", logs.traceback_summary(F.col("output")).alias("s")).select("o_orderkey", "s.*")


@query("""WITH f AS (SELECT l_orderkey AS o_orderkey, list_sort(list_distinct(list('src/m' || l_suppkey || '.py') FILTER (l_linenumber > 1))) AS files FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'test_' || o_orderkey || 'a' AS first_test, 'About ' || o_orderpriority AS description, 2 AS n_tests, ['AssertionError', 'KeyError'] AS exception_types, ['pkg.mod' || o_custkey % 50] AS test_modules, coalesce(files, []) AS source_files, o_custkey % 90 + 2 AS total_tests, o_custkey % 4 AS total_failures, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 7 ELSE 0 END AS total_errors FROM orders JOIN f USING (o_orderkey)""")
def parsed_outputs(spark, d):
    """failing tests, tracebacks, files and totals of a unit-test output."""
    p = _outputs(spark, d).select("o_orderkey", logs.parsed_output(F.col("output")).alias("p"))
    test = F.get("p.failing_tests", 0)
    return p.select("o_orderkey", test["method"].alias("first_test"), test["description"].alias("description"), F.size("p.failing_tests").cast("long").alias("n_tests"), "p.exception_types", "p.test_modules", "p.source_files", "p.total_tests", "p.total_failures", "p.total_errors")


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(t, '(?im)^(\s*api_key\s*:\s*)(.+)$', '\1<REDACTED>', 'g'), 'sk-[A-Za-z0-9_-]{10,}', 'sk-<REDACTED>', 'g')) AS redacted FROM (SELECT doc_id, concat(text, chr(10), '  API_key : ', source, ' ', doc_id, chr(10), 'model: x', chr(10), 'also sk-', md5(source), ' here') AS t FROM documents)")
def redacted_texts(spark, d):
    """Lines of key settings masked to their end, and keys of a known form anywhere; the digest of the whole text."""
    text = F.concat("text", F.lit("\n  API_key : "), "source", F.lit(" "), F.col("doc_id").cast("string"), F.lit("\nmodel: x\nalso sk-"), F.md5("source"), F.lit(" here"))
    return table(spark, d, "documents").select("doc_id", F.md5(scalars.redact(text)).alias("redacted"))

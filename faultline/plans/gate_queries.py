"""Queries on what may pass: seeds, problem texts, tests and patches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import gates
from ..functions import scalars as s
from .fixtures import spread, table
from .registry import query

#: Problem texts and the code before and after a defect, as expressions that both engines read.
BEFORE = "concat('def run_', o_custkey % 31, '(order):', chr(10), '    total = compute_total(order, tax', o_custkey % 17, ')', chr(10), '    return total')"
AFTER = "concat('def run_', o_custkey % 31, '(order):', chr(10), '    total = compute_total(order, ', o_orderkey % 13, ')', chr(10), '    return total')"
TEXT = f"""CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 41 = 1 THEN 'Synthetic defect' WHEN o_orderkey % 41 = 2 THEN concat('Bad total ', o_orderkey) ELSE concat('Order ', o_orderkey, ' of customer ', o_custkey, ' ', CASE o_orderstatus WHEN 'F' THEN 'returns a wrong total' WHEN 'O' THEN 'has a total of nothing' ELSE 'Produces zero' END,
  CASE o_custkey % 14 WHEN 0 THEN concat('. The fix is to add ', o_orderpriority, '. It stays so.') WHEN 1 THEN concat('. You should use round', o_custkey, ' here. Later it is gone.') WHEN 2 THEN '! Running the tests shows it. Then it stops.' WHEN 3 THEN '. It is missing the import of it? Later text stays.'
  WHEN 4 THEN ' instead of the expected total of the customer account that the report of the month shows again and again' WHEN 5 THEN concat('. Replace foo', o_custkey, ' with bar.', chr(10), 'Nothing else happens.') WHEN 6 THEN '. Only pytest fails. Not the rest.' WHEN 7 THEN concat('. It reads total = compute_total(order, tax', o_custkey % 17, ') and more.')
  WHEN 8 THEN concat('. The value needs to be 7 as total = compute_total(order, ', o_orderkey % 13, ') says.') WHEN 9 THEN concat('.', repeat(' word', CAST(o_custkey % 80 AS INT))) WHEN 10 THEN '. In method run of thing.py it breaks.' WHEN 11 THEN '. The root cause is the tax.' WHEN 12 THEN concat(', where test_', o_custkey, ' fails for all customers of the region and the nation.') ELSE '' END) END"""
LEVEL = "CASE o_orderkey % 4 WHEN 0 THEN 'minimal' WHEN 1 THEN 'standard' WHEN 2 THEN 'detailed' ELSE 'other' END"
_HITS = lambda ps: " OR ".join(f"regexp_matches(t, '(?i){p}')" for p in ps)


def _orders(spark, d):
    return spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", *[F.expr(e).alias(c) for c, e in (("t", TEXT), ("level", LEVEL), ("before", BEFORE), ("after", AFTER))])


_T = f"o AS (SELECT o_orderkey, {TEXT} AS t, {LEVEL} AS level, o_custkey, o_orderkey % 13 AS m FROM orders)"


@query(f"""WITH {_T}, n AS (SELECT *, len(regexp_extract_all(t, '\\S+')) AS n, {" + ".join(f"regexp_matches(t, '(?i){p}')::INT" for p in gates.DIRECTIVES)} AS k FROM o)
SELECT o_orderkey, CASE WHEN n = 0 THEN 'empty_ps' WHEN contains(t, 'Synthetic defect') THEN 'fallback_detected' WHEN n < 8 THEN 'too_short (' || n || ' tokens)' WHEN k > 0 THEN 'fix_leak_detected (' || k || ' patterns)'
  WHEN level = 'minimal' AND n > 60 THEN 'too_verbose_for_minimal (' || n || ' tokens)' WHEN level = 'standard' AND n < 15 THEN 'too_short_for_standard (' || n || ' tokens)' WHEN level = 'standard' AND NOT regexp_matches(t, '(?i)\\b(when|instead of|expected|returns|produces|should|fails to)\\b') THEN 'missing_behavioral_desc_for_standard' WHEN level = 'detailed' AND n < 30 THEN 'too_short_for_detailed (' || n || ' tokens)' END AS reason FROM n""")
def text_refusals(spark, d):
    """Why problem texts are refused at their level."""
    return _orders(spark, d).select("o_orderkey", gates.text_refusal(F.col("t"), F.col("level")).alias("reason"))


_CLEAN = lambda t, ps: reduce(lambda a, p: f"regexp_replace({a}, '(?i)[^.!?\\n]*{p}[^.!?\\n]*[.!?]?\\s*', '', 'g')", ps, t)
_L1, _L2 = "'total = compute_total(order, tax' || o_custkey % 17 || ')'", "'total = compute_total(order, ' || m || ')'"


@query(f"""WITH {_T}, c AS (SELECT *, {_HITS(gates.DIRECTIVES)} AS directed, contains(t, {_L1}) OR contains(t, {_L2}) AS quoted, {_HITS((*gates.TEST_MENTIONS, *gates.IMPLICIT))} AS hinted, regexp_extract(t, '^([^.!?\\n]{{15,}}[.!?])', 1) AS head FROM o),
k AS (SELECT *, regexp_replace({_CLEAN(f"replace(replace({_CLEAN('t', gates.DIRECTIVES)}, {_L1}, '[CODE]'), {_L2}, '[CODE]')", (*gates.TEST_MENTIONS, *gates.IMPLICIT))}, '^\\s+|\\s+$', '', 'g') AS clean FROM c)
SELECT o_orderkey, CASE WHEN NOT (directed OR quoted OR hinted) THEN t WHEN directed AND quoted THEN CASE WHEN head <> '' AND NOT ({_HITS(gates.DIRECTIVES).replace('(t,', '(head,')}) THEN head ELSE 'Synthetic defect' END WHEN clean = '' THEN 'Synthetic defect' ELSE clean END AS clean FROM k""")
def sanitized_texts(spark, d):
    """Problem texts without directives, lines of the patch, mentions of tests and implicit leaks."""
    return _orders(spark, d).select("o_orderkey", gates.sanitized(F.col("t"), F.col("before"), F.col("after")).alias("clean"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 OR o_orderstatus = 'P' AND o_custkey % 3 = 0 THEN 'no chain or intent' WHEN o_custkey % 5 < 2 THEN 'chain too short (' || o_custkey % 5 || ' < 2)' WHEN o_orderpriority = '5-LOW' THEN 'Complex_Logic_Rewrite is excluded' WHEN o_custkey % 7 IN (0, 1) THEN 'no code transformation' END AS reason FROM orders""")
def seed_refusals(spark, d):
    """Why seeds are not synthesised."""
    o = table(spark, d, "orders")
    k = F.col("o_custkey")
    length = F.when(k % 11 != 0, (k % 5).cast("int"))
    intent = F.when(~((F.col("o_orderstatus") == "P") & (k % 3 == 0)), F.when(F.col("o_orderpriority") == "5-LOW", "Complex_Logic_Rewrite").otherwise(F.concat(F.lit("Kind"), "o_orderpriority")))
    return o.select("o_orderkey", gates.seed_refusal(length, intent, F.when(k % 7 != 0, "a = 1"), F.when(k % 7 != 1, F.concat(F.lit("b = "), "o_orderstatus")).otherwise("")).alias("reason"))


_TEST = "concat(CASE WHEN event_id % 5 = 0 THEN ' ' ELSE '' END, 'tests/t_', event_type, CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('.py::test_', CAST(floor(value) AS BIGINT) % 37) END)"


@query(f"""WITH t AS (SELECT event_id, user_id, {_TEST} AS test, trim({_TEST}) AS s FROM events), a AS (SELECT DISTINCT user_id, s FROM t WHERE event_id % 4 = 0 AND user_id % 5 <> 0)
SELECT event_id, test FROM t WHERE user_id NOT IN (SELECT user_id FROM a) OR EXISTS (SELECT 1 FROM a WHERE a.user_id = t.user_id AND (a.s = t.s OR (contains(t.s, '::') AND contains(a.s, '::') AND string_split(a.s, '::')[1] = string_split(t.s, '::')[1] AND a.s LIKE '%.py::%')))""")
def allowed_tests(spark, d):
    """Tests of the allowed suite, or of a file of it; all where there is none."""
    t = table(spark, d, "events").select("event_id", "user_id", F.expr(_TEST).alias("test"))
    return gates.allowed_tests(t, t.where("event_id % 4 = 0 and user_id % 5 <> 0").select("user_id", "test"), "user_id").select("event_id", "test")


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 9 = 1 THEN 'tests/t_click.py::test_bug_' || user_id WHEN event_id % 9 = 2 THEN 'tests/t_view.py' ELSE 'tests/t_' || event_type || '.py::TestX::test_' || CAST(floor(value) AS BIGINT) END AS test FROM events)
SELECT event_id, test, event_id % 9 <> 1 AND string_split(test, '::')[1] IN ('tests/t_click.py', 'tests/t_view.py', 'tests/t_error.py') AS valid FROM t WHERE test <> ''""")
def existing_tests(spark, d):
    """Tests that are no placeholders and whose files exist."""
    e = table(spark, d, "events")
    test = F.expr("CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 9 = 1 THEN concat('tests/t_click.py::test_bug_', user_id) WHEN event_id % 9 = 2 THEN 'tests/t_view.py' ELSE concat('tests/t_', event_type, '.py::TestX::test_', CAST(floor(value) AS BIGINT)) END")
    files = e.where("event_type in ('click', 'view', 'error')").select(F.concat(F.lit("tests/t_"), "event_type", F.lit(".py")).alias("file"))
    return gates.existing_tests(e.select("event_id", test.alias("test")), files)


@query("""SELECT p_partkey, p_name || '.' || p_type AS label, coalesce(len(list_filter(['small', 'blue ring', 'large.ECO'], lambda p: trim(p_name || '.' || p_type) = p OR starts_with(p_name || '.' || p_type, p || '.'))) > 0, false) AS disallowed FROM part
UNION ALL SELECT DISTINCT -1, p_name, p_name IN ('small', 'blue ring', 'large.ECO') FROM part""")
def disallowed_labels(spark, d):
    """Labels equal to or below a disallowed prefix."""
    p = table(spark, d, "part")
    rows = p.select("p_partkey", F.concat_ws(".", "p_name", "p_type").alias("label")).unionByName(p.select(F.lit(-1).cast("long").alias("p_partkey"), F.col("p_name").alias("label")).distinct())
    return rows.withColumn("disallowed", gates.is_disallowed(F.col("label"), F.array(*[F.lit(x) for x in ("small", "blue ring", "large.ECO")])))


_NODES = """nodes AS (SELECT 'lib/m' || s_nationkey || '.py:C' || s_suppkey % 9 AS node_id, 'class' AS type, CASE WHEN min(s_suppkey) % 4 = 0 THEN ' ' ELSE 'class C: pass' END AS code FROM supplier GROUP BY 1
  UNION ALL SELECT 'lib/m' || s_nationkey || '.py:C' || s_suppkey % 9 || '.run' || s_suppkey, 'function', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'def run(): return ' || s_suppkey END FROM supplier WHERE s_acctbal > 2000
  UNION ALL SELECT 'lib/m' || s_nationkey || '.py:f' || s_suppkey, 'function', 'def f(): pass' FROM supplier UNION ALL SELECT DISTINCT 'lib/m' || s_nationkey || '.py', 'file', 'import x' FROM supplier)"""


@query(f"WITH {_NODES} SELECT node_id, type FROM nodes n WHERE type <> 'file' AND trim(code) <> '' AND NOT (type = 'class' AND EXISTS (SELECT 1 FROM nodes m WHERE m.type = 'function' AND trim(m.code) <> '' AND starts_with(m.node_id, n.node_id || '.') AND NOT contains(substr(m.node_id, length(n.node_id) + 2), '.')))")
def embeddable_nodes(spark, d):
    """Nodes to embed: functions and classes with code, no classes whose methods are among them."""
    p = table(spark, d, "supplier")
    node = F.concat(F.lit("lib/m"), "s_nationkey", F.lit(".py:C"), (F.col("s_suppkey") % 9).cast("string"))
    classes = p.groupBy(node.alias("node_id")).agg(F.min("s_suppkey").alias("k")).select("node_id", F.lit("class").alias("type"), F.when(F.col("k") % 4 == 0, " ").otherwise("class C: pass").alias("code"))
    methods = p.where("s_acctbal > 2000").select(F.concat(node, F.lit(".run"), "s_suppkey").alias("node_id"), F.lit("function").alias("type"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("def run(): return "), "s_suppkey")).alias("code"))
    functions = p.select(F.concat(F.lit("lib/m"), "s_nationkey", F.lit(".py:f"), "s_suppkey").alias("node_id"), F.lit("function").alias("type"), F.lit("def f(): pass").alias("code"))
    files = p.select(F.concat(F.lit("lib/m"), "s_nationkey", F.lit(".py")).alias("node_id"), F.lit("file").alias("type"), F.lit("import x").alias("code")).distinct()
    return gates.embeddable(classes.unionByName(methods).unionByName(functions).unionByName(files)).select("node_id", "type")


#: Pairs of codes by a kind of change: (reason, code before, code after).
_CHANGES = (
    ("NULL", "concat('x = ', p_partkey)", "concat('x = ', p_size, ' + ', p_partkey)"),
    ("'empty'", "'x = 1'", "'x = 1'"),
    ("'invalid syntax'", "concat('x = ', p_size)", "concat('x = (', p_size)"),
    ("'white space only'", "concat('x = ', p_size)", "concat('x  =  ', p_size)"),
    ("'new comments'", "concat('x = ', p_size)", "concat('x = ', p_size + 1, '  # was ', p_size)"),
    ("'docstrings changed'", "concat('def f():', chr(10), '    \"\"\"Doc ', p_size, '.\"\"\"', chr(10), '    return 1')", "concat('def f():', chr(10), '    \"\"\"Doc.\"\"\"', chr(10), '    return ', p_size)"),
    ("'trivial only'", "concat('x = ', p_size)", "concat('x = ', p_size, chr(10), 'print(', p_partkey, ')')"),
    ("'comments only'", "concat('# one ', p_size, chr(10), 'x = 1')", "'x = 1'"),
)
_OF = lambda k: "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(_CHANGES)) + " END"
_DIFF = """CASE p_partkey % 8 WHEN 1 THEN ' ' WHEN 6 THEN concat('+++ b/x.py', chr(10), '@@ -1 +1,2 @@', chr(10), '+print(', p_partkey, ')') WHEN 7 THEN concat('--- a/x.py', chr(10), '-# one ', p_size) ELSE concat('--- a/x.py', chr(10), '+++ b/x.py', chr(10), '-x = ', p_size, chr(10), '+x = ', p_partkey) END"""


@query(f"SELECT p_partkey, {_OF(0)} AS reason FROM part")
def patch_refusals(spark, d):
    """Why patches change nothing of meaning."""
    rows = spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(_DIFF).alias("patch"), F.expr(_OF(1)).alias("before"), F.expr(_OF(2)).alias("after"))
    return rows.select("p_partkey", gates.patch_refusal(F.col("patch"), F.col("before"), F.col("after")).alias("reason"))


_KINDS = "CASE p_partkey % 9 WHEN 0 THEN 'Constant_Update' WHEN 1 THEN 'Condition_Refinement' WHEN 2 THEN 'Guard_Clause_Addition' WHEN 3 THEN 'Argument_Update' WHEN 4 THEN 'Exception_Fix' WHEN 5 THEN 'API_Replacement' WHEN 6 THEN 'Variable_Replacement' WHEN 7 THEN 'Constant_Update' ELSE 'Else' END"
_CATEGORY = "CASE p_size % 4 WHEN 0 THEN 'regex_pattern' WHEN 1 THEN 'numeric_constant' WHEN 2 THEN 'string_constant' ELSE 'odd' END"
_CHANGED = "concat('y', p_size, CASE p_partkey % 7 WHEN 0 THEN ' = r\"a$\"' WHEN 1 THEN ' > 3' WHEN 2 THEN concat(' = f(a, b=', p_size, ')') WHEN 3 THEN ' = obj.call(x)' WHEN 4 THEN concat(' raise KeyError ', p_name) WHEN 5 THEN ' = ''text''' ELSE ' q' END)"
_SIGNS = "CASE kind " + " ".join(f"""WHEN '{k}' THEN CASE WHEN regexp_matches(c, '{p.replace("'", "''")}') THEN {h} ELSE {m} END""" for k, (p, h, m) in gates.INTENT_SIGNS.items())


@query(rf"""WITH c AS (SELECT p_partkey, {_KINDS} AS kind, {_CATEGORY} AS cat, CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE 1 + p_partkey % 23 END AS n_add, p_partkey % 3 AS n_del, {_CHANGED} AS line FROM part),
s AS (SELECT *, array_to_string(list_transform(range(n_add + n_del), lambda i: line), ' ') AS c FROM c),
v AS (SELECT *, CASE WHEN kind = 'Constant_Update' THEN CASE WHEN cat LIKE 'regex%' THEN CASE WHEN regexp_matches(c, '[r]?["''][^"'']*[\$\\][^"'']*["'']') THEN 0.9 WHEN regexp_matches(c, '[r]?["''][^"'']+["'']') THEN 0.7 ELSE 0 END WHEN cat LIKE 'numeric%' THEN CASE WHEN regexp_matches(c, '\d+') THEN 0.8 ELSE 0 END WHEN cat LIKE 'string%' THEN CASE WHEN regexp_matches(c, '["''][^"'']+["'']') THEN 0.8 ELSE 0 END ELSE CASE WHEN regexp_matches(c, '["''][^"'']*["'']|\d+') THEN 0.6 ELSE 0 END END
  WHEN kind = 'Variable_Replacement' THEN CASE WHEN n_add > 0 AND n_del > 0 THEN 0.6 ELSE 0.3 END ELSE {_SIGNS} ELSE 0.5 END END AS v FROM s)
SELECT p_partkey, round(CASE WHEN n_add + n_del = 0 THEN 0 WHEN n_add + n_del <= 10 THEN least(1, v + 0.1) WHEN n_add + n_del > 20 THEN greatest(0, v - 0.2) ELSE v END, 6)::DOUBLE AS fit FROM v""")
def intent_fits(spark, d):
    """how well changed lines fit the kind of repair."""
    lines = lambda n: F.array_repeat(F.expr(_CHANGED), n)
    added, removed = lines(F.expr("CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE cast(1 + p_partkey % 23 AS INT) END")), lines(F.expr("cast(p_partkey % 3 AS INT)"))
    return table(spark, d, "part").select("p_partkey", F.round(gates.intent_fit(added, removed, F.expr(_KINDS), F.expr(_CATEGORY)), 6).alias("fit"))


_CODE = "concat('v', p_size, ' = f(', p_brand_, ', ', p_partkey, ') + f(v', p_size, ')  # ', p_name, chr(10), CASE WHEN p_partkey % 3 = 0 THEN 'if v: pass' ELSE 'w = v' END, chr(10))".replace("p_brand_", "replace(p_brand, '#', '_')")


@query(rf"""WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(regexp_replace({_CODE}, '#[^\n]*', ''), '\w+|[^\w\s]')) AS w FROM part), c AS (SELECT p_partkey, w, count(*) AS n FROM t GROUP BY ALL)
SELECT p_partkey, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY 1""")
def code_entropies(spark, d):
    """entropy of the tokens of code."""
    return table(spark, d, "part").select("p_partkey", F.round(gates.code_token_entropy(F.expr(_CODE)), 6).alias("entropy"))


_KEYWORDS = ("def", "class", "return", "import", "from", "if", "else", "elif", "for", "while", "try", "except", "finally", "with", "as", "pass", "break", "continue", "raise", "yield", "not", "and", "or", "is", "in", "True", "False", "None", "self", "lambda", "assert")
_IDS = f"list_filter(list_distinct(regexp_extract_all({{c}}, '[A-Za-z_][A-Za-z0-9_]{{{{2,}}}}')), lambda x: x NOT IN ({', '.join(repr(k) for k in _KEYWORDS)}))"


@query(f"""WITH o AS (SELECT o_orderkey, {TEXT} AS t, {_IDS.format(c=AFTER).replace('{{2,}}', '{2,}')} AS ids FROM orders)
SELECT o_orderkey, len(ids) AS n_ids, round(CASE WHEN len(ids) = 0 THEN 0 ELSE len(list_filter(ids, lambda x: contains(lower(t), lower(x)))) / len(ids) END, 6) AS density FROM o""")
def identifier_densities(spark, d):
    """Identifiers of code and the share of them in a text."""
    ids = s.identifiers(F.col("after"), list(_KEYWORDS))
    return _orders(spark, d).select("o_orderkey", F.size(ids).cast("long").alias("n_ids"), F.round(s.identifier_density(F.col("t"), ids), 6).alias("density"))


_FILES = "[concat('src/', o_orderstatus, '_orders/', lower(o_orderpriority), '/get_total', o_custkey % 7, '.py'), concat('tests/customer_', o_custkey % 5, '/order.py')]"


@query(rf"""WITH o AS (SELECT o_orderkey, lower({TEXT}) AS t, {_FILES} AS fs FROM orders), p AS (SELECT o_orderkey, t, unnest(fs) AS f FROM o),
w AS (SELECT o_orderkey, t, unnest(list_concat(list_filter(string_split(regexp_replace(regexp_extract(f, '[^/]*$'), '\.[^.]*$', ''), '_'), lambda x: length(x) > 2), list_transform(list_filter(string_split(f, '/'), lambda x: length(x) > 2 AND x <> 'tests'), lambda x: replace(x, '.py', '')))) AS x FROM p)
SELECT o_orderkey, count(DISTINCT x) AS n_signals, count(DISTINCT x) FILTER (contains(t, lower(x))) AS n_found, round(count(DISTINCT x) FILTER (contains(t, lower(x))) / count(DISTINCT x), 6) AS ratio FROM w GROUP BY 1""")
def chain_signals(spark, d):
    """F8: words of a chain's paths, and those that a text holds."""
    files = F.expr(_FILES.replace("[concat", "array(concat", 1)[:-1] + ")")
    found = s.chain_signals(F.col("t"), F.col("files"))
    o = table(spark, d, "orders").select("o_orderkey", F.expr(TEXT).alias("t"), files.alias("files"))
    return o.select("o_orderkey", found.alias("f")).select("o_orderkey", F.col("f.n_signals").cast("long").alias("n_signals"), F.col("f.n_found").cast("long").alias("n_found"), F.round("f.ratio", 6).alias("ratio"))

"""Queries on chains and on the problem texts made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chains, logs, problem_texts
from .fixtures import table
from .log_queries import _outputs
from .registry import query

#: A turn of a conversation as a node of a chain.
_NODE = "concat('src/', CASE conv_id % 5 WHEN 0 THEN 'core' WHEN 1 THEN 'core/db' WHEN 2 THEN 'web/api' WHEN 3 THEN 'core/db/sql' ELSE 'lib' END, '/', role, turn % 3, '.py:', CASE (conv_id + turn) % 4 WHEN 0 THEN concat('get_', conv_id % 7) WHEN 1 THEN concat('Thing', conv_id % 3, '.run') WHEN 2 THEN concat('load', turn) ELSE concat('get', turn) END)"
_TYPE = "CASE WHEN turn = 0 THEN 'symptom' WHEN role = 'assistant' THEN 'root_cause' ELSE 'intermediate' END"


def _chains(spark, d):
    """chain_id and nodes, in order."""
    c = table(spark, d, "conversations")
    node = F.struct("turn", F.expr(_NODE).alias("node_id"), F.expr(_TYPE).alias("node_type"), F.when(F.col("turn") % 2 == 0, F.substring_index(F.expr(_NODE), ":", 1)).alias("file_path"))
    nodes = F.transform(F.array_sort(F.collect_list(node)), lambda n: F.struct(n["node_id"].alias("node_id"), n["node_type"].alias("node_type"), n["file_path"].alias("file_path")))
    return c.groupBy(F.col("conv_id").alias("chain_id")).agg(nodes.alias("nodes"))


_C = f"c AS (SELECT conv_id AS chain_id, turn, {_NODE} AS node, {_TYPE} AS type FROM conversations), n AS (SELECT chain_id, count(*) AS n, arg_max(node, turn) AS last FROM c GROUP BY 1)"


@query(f"""WITH {_C}, p AS (SELECT a.chain_id AS seed, b.chain_id AS other, a.n AS na, b.n AS nb, a.last AS la, b.last AS lb, string_split(string_split(a.last, ':')[1], '/') AS pa, string_split(string_split(b.last, ':')[1], '/') AS pb FROM n a JOIN n b ON b.chain_id = a.chain_id + 1),
s AS (SELECT seed, count(*) FILTER (x.type = y.type) AS same FROM p JOIN (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY turn) AS k FROM c) x ON x.chain_id = seed JOIN (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY turn) AS k FROM c) y ON y.chain_id = other AND y.k = x.k GROUP BY seed),
f AS (SELECT *, len(list_filter(range(1, least(len(pa), len(pb))), lambda i: pa[1:i] = pb[1:i])) AS common, string_split(la, ':')[2] AS fa, string_split(lb, ':')[2] AS fb FROM p JOIN s USING (seed)),
g AS (SELECT *, CASE WHEN common >= 2 THEN 0.9 WHEN common >= 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS base, CASE WHEN contains(fa, '_') THEN string_split(fa, '_')[1] ELSE substr(fa, 1, 4) END = CASE WHEN contains(fb, '_') THEN string_split(fb, '_')[1] ELSE substr(fb, 1, 4) END AS alike FROM f),
h AS (SELECT *, CASE WHEN pa[-1] = pb[-1] THEN least(base + 0.1, 1) ELSE base END AS filed FROM g),
k AS (SELECT *, CASE WHEN alike THEN least(filed + 0.05, 1) ELSE filed END AS semantic FROM h)
SELECT seed, round(1 - abs(na - nb) / greatest(na, nb), 6) AS depth_match, round(same / greatest(na, nb), 6) AS structure, round(semantic, 6) AS semantic, round(0.4::DOUBLE * (1 - abs(na - nb) / greatest(na, nb)) + 0.4::DOUBLE * same / greatest(na, nb) + 0.2::DOUBLE * semantic, 6) AS overall FROM k""")
def aligned_chains(spark, d):
    """Alignment of each chain with the one before: depth, types by position and place of the root cause."""
    c = _chains(spark, d)
    pairs = c.select(F.col("chain_id").alias("seed"), F.col("nodes").alias("a")).join(c.select((F.col("chain_id") - 1).alias("seed"), F.col("nodes").alias("b")), "seed")
    s = pairs.select("seed", chains.chain_alignment(F.col("a"), F.col("b")).alias("s"))
    return s.select("seed", *[F.round(f"s.{k}", 6).alias(k) for k in ("depth_match", "structure", "semantic", "overall")])


_GIVEN = "CASE conv_id % 6 WHEN 0 THEN concat('[\"', {n}, '\", null, \" \", \"x', turn, '\"]') WHEN 1 THEN concat('{{\"nodes\": [{{\"node_id\": \"', {n}, '\"}}, {{\"id\": \"b', turn, '\"}}, {{\"name\": \"c\"}}, {{\"other\": 1}}]}}') WHEN 2 THEN concat('  ', {n}, ' ') WHEN 3 THEN '' WHEN 4 THEN concat('{{\"edges\": ', turn, '}}') ELSE concat('[', turn, ', \"', {n}, '\"]') END".format(n=_NODE)


@query(f"SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN [{_NODE}, 'x' || turn] WHEN 1 THEN [{_NODE}, 'b' || turn, 'c'] WHEN 2 THEN [{_NODE}] WHEN 5 THEN [turn::VARCHAR, {_NODE}] ELSE [] END AS nodes FROM conversations")
def normalized_chains(spark, d):
    """node ids of chains in their many spellings."""
    return table(spark, d, "conversations").select("conv_id", "turn", chains.normalized_chain(F.expr(_GIVEN)).alias("nodes"))


@query(f"""WITH c AS (SELECT conv_id, list_filter(list_transform(string_split(string_agg({_NODE}, ' , ' ORDER BY turn), ','), lambda x: trim(x)), lambda x: x <> '')[1:greatest(conv_id % 5, 2) + 1] AS ids FROM conversations GROUP BY conv_id)
SELECT conv_id, unnest(ids) AS node_id, generate_subscripts(ids, 1) - 1 AS pos, CASE generate_subscripts(ids, 1) WHEN 1 THEN 'symptom' WHEN len(ids) THEN 'root_cause' ELSE 'intermediate' END AS node_type FROM c""")
def structured_chains(spark, d):
    """Chains written as text, cut by the length of their seed, with types by place."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.expr(_NODE).alias("n")))), lambda x: x["n"]), " , ")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(text.alias("t"))
    return rows.select("conv_id", F.posexplode(chains.structured_chain(F.col("t"), (F.col("conv_id") % 5).cast("int"))).alias("pos", "n")).select("conv_id", "pos", "n.node_id", "n.node_type")


@query("""WITH li AS (SELECT l_orderkey AS o, l_linenumber AS k, min(l_partkey) AS p, arg_min(l_suppkey, (l_partkey, l_suppkey)) AS s, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
nodes AS (SELECT o, k, 'src/m' || s || '.py:fn_' || p AS node, 'src/m' || s || '.py' AS file, 'fn_' || p AS func FROM li WHERE k <= 5), frames AS (SELECT o, 'a' AS test, row_number() OVER (PARTITION BY o ORDER BY k) AS i, 'src/m' || s || '.py fn_' || p || ' x' AS t FROM li WHERE q > 20 UNION ALL SELECT o, 'b', row_number() OVER (PARTITION BY o ORDER BY p, k), 'src/m' || s || '.py fn_' || p || ' x' FROM li WHERE q <= 35),
total AS (SELECT o, count(*) AS n, any_value(node) FILTER (k = 2) AS target FROM nodes GROUP BY o), places AS (SELECT n.o, test, n.k, node, min(i) AS i FROM nodes n JOIN frames f ON f.o = n.o AND (contains(t, file) OR contains(t, func)) GROUP BY ALL),
tests AS (SELECT o, test, count(DISTINCT node) AS m, count(*) AS c FROM places GROUP BY ALL), wrong AS (SELECT x.o, x.test, count(*) AS w FROM places x JOIN places y ON x.o = y.o AND x.test = y.test AND x.k < y.k AND x.i > y.i GROUP BY ALL),
judged AS (SELECT o, m / n AS cov, CASE WHEN m < 2 THEN 0 ELSE 1 - coalesce(w, 0) / (c * (c - 1) / 2) END AS ord FROM tests JOIN total USING (o) LEFT JOIN wrong USING (o, test)), best AS (SELECT o, arg_max(cov, (cov, ord)) AS cov, arg_max(ord, (cov, ord)) AS ord FROM judged GROUP BY o)
SELECT o AS l_orderkey, n AS total_nodes, round(coalesce(cov, 0), 4) AS trace_coverage, coalesce(target IN (SELECT node FROM places x WHERE x.o = t.o), false) AS target_hit, round(coalesce(ord, 0), 4) AS causal_ordering, round(0.5::DOUBLE * coalesce(cov, 0) + CASE WHEN coalesce(target IN (SELECT node FROM places x WHERE x.o = t.o), false) THEN 0.25 ELSE 0 END + 0.25::DOUBLE * coalesce(ord, 0), 4) AS overall FROM total t LEFT JOIN best USING (o)""")
def trace_alignment(spark, d):
    """How well failing tests run through a proposed chain."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg(F.min("l_partkey").alias("p"), F.min_by("l_suppkey", F.struct("l_partkey", "l_suppkey")).alias("s"), F.min("l_quantity").alias("q"))
    node = F.expr("concat('src/m', s, '.py:fn_', p)")
    frame = F.struct(F.expr("concat('src/m', s, '.py')").alias("file_path"), F.expr("concat('fn_', p)").alias("function"), F.lit("x").alias("code"))
    listed = lambda key, x, cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(*key, x.alias("x"))))), lambda y: y["x"])
    g = li.groupBy("l_orderkey").agg(listed(["k"], node, F.col("k") <= 5).alias("chain"), F.max(F.when(F.col("k") == 2, node)).alias("target"), F.array(listed(["k"], frame, F.col("q") > 20), listed(["p", "k"], frame, F.col("q") <= 35)).alias("traces"))
    s = g.where(F.size("chain") > 0).select("l_orderkey", chains.trace_alignment(F.col("chain"), F.col("target"), F.col("traces")).alias("s"))
    return s.select("l_orderkey", F.col("s.total_nodes").cast("long").alias("total_nodes"), "s.trace_coverage", "s.target_hit", "s.causal_ordering", "s.overall")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND (c < 0.4 OR NOT hit) THEN 'invalid' WHEN o_orderstatus = 'F' THEN 'valid' ELSE 'error' END AS enforced, CASE WHEN o_orderstatus = 'F' THEN 'valid' ELSE 'error' END AS shadowed, CASE WHEN o_orderstatus = 'F' AND c < 0.4 THEN 'Chain coverage too low: ' || format('{:.2f}', c) || ' < 0.40' WHEN o_orderstatus = 'F' AND NOT hit THEN 'Target node not observed in failing traceback' END AS reason FROM (SELECT *, o_custkey % 100 / 100 AS c, o_custkey % 3 = 0 AS hit FROM orders)""")
def admissions(spark, d):
    """Valid defects with too little coverage, refused or only noted."""
    status, c, hit = F.when(F.col("o_orderstatus") == "F", "valid").otherwise("error"), F.col("o_custkey") % 100 / 100, F.col("o_custkey") % 3 == 0
    both = [chains.admission(status, c, hit, 0.4, True, e) for e in (True, False)]
    return table(spark, d, "orders").select("o_orderkey", both[0]["status"].alias("enforced"), both[1]["status"].alias("shadowed"), both[1]["reason"].alias("reason"))


_MOD = lambda f: f"CASE WHEN regexp_extract({f}, '([^/]*)\\.py$', 1) IN ('__init__', 'utils', 'base', 'models', 'views', 'tests') THEN coalesce(list_filter(string_split({f}, '/')[:-2], lambda x: x NOT IN ('', 'src', 'lib', 'django', 'tests', '__pycache__'))[-1], regexp_extract({f}, '([^/]*)\\.py$', 1)) ELSE regexp_extract({f}, '([^/]*)\\.py$', 1) END"


@query(f"""WITH {_C}, e AS (SELECT *, string_split(node, ':')[1] AS file, string_split(string_split(node, ':')[2], '.')[-1] AS fn, CASE WHEN contains(string_split(node, ':')[2], '.') THEN string_split(string_split(node, ':')[2], '.')[1] END AS cls, CASE WHEN turn % 2 = 0 THEN {_MOD("string_split(node, ':')[1]")} END AS mod FROM c), l AS (SELECT unnest(['L1', 'L2', 'L3']) AS level)
SELECT chain_id, level, coalesce(list_sort(list(DISTINCT mod) FILTER (mod IS NOT NULL AND (type = 'symptom' OR (level <> 'L1' AND type = 'intermediate') OR level = 'L3'))), []) AS modules, coalesce(list_sort(list(DISTINCT fn) FILTER (type = 'symptom' OR (level <> 'L1' AND type = 'intermediate') OR level = 'L3')), []) AS functions,
  coalesce(list_sort(list(DISTINCT cls) FILTER (cls IS NOT NULL AND (type = 'symptom' OR (level <> 'L1' AND type = 'intermediate')))), []) AS classes, coalesce(list_sort(list(DISTINCT node) FILTER (type = 'root_cause')), []) AS forbidden FROM e, l GROUP BY ALL""")
def exposed_entities(spark, d):
    """B1: what a problem text may tell of a chain at each level."""
    rows = _chains(spark, d).select("chain_id", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), chains.exposed(F.col("nodes"), k).alias("e")) for k in problem_texts.LEVELS])).alias("x"))
    return rows.select("chain_id", "x.level", "x.e.modules", "x.e.functions", "x.e.classes", "x.e.forbidden")


#: What a traceback tells, in all its kinds, for a customer.
_SUMMARY = "CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'AssertionError' WHEN 2 THEN 'TypeError' WHEN 3 THEN 'AttributeError' WHEN 4 THEN 'ValueError' WHEN 5 THEN 'KeyError' ELSE 'OSError' END"
_MESSAGE = "CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN repeat(c_name, 8) ELSE concat('bad ', c_name) END"
_LIST = lambda name, n, m: f"list_transform(range(c_custkey % {m}), lambda i: '{name}' || (c_nationkey + i * {n}) % 10)"
_ASSERT = "list_transform(range(c_custkey % 4), lambda i: 'AssertionError: ' || c_mktsegment || i || ' != 3')"


@query(rf"""WITH s AS (SELECT c_custkey, {_SUMMARY} AS k, {_MESSAGE} AS m, list_sort(list_distinct({_LIST("mod", 3, 5)})) AS ms, list_sort(list_distinct({_LIST("Cls", 7, 3)})) AS cs, list_sort(list_distinct({_LIST("fn", 1, 6)})) AS fs, list_sort(list_distinct({_LIST("pkg.t", 1, 4)})) AS ts, {_ASSERT} AS aa FROM customer),
a AS (SELECT *, concat_ws(' ', CASE WHEN len(ms) > 0 THEN 'An issue has been identified in the ' || ms[1] || ' module.' END, CASE WHEN k LIKE '%Assertion%' THEN 'Certain operations produce incorrect results.' WHEN k LIKE '%Type%' THEN 'A type-related error occurs during processing.' WHEN k LIKE '%Attribute%' THEN 'An attribute access fails unexpectedly.' WHEN k LIKE '%Value%' THEN 'An operation receives or produces an invalid value.' WHEN k LIKE '%Key%' THEN 'A dictionary lookup fails for an expected key.' WHEN k <> '' THEN 'The operation raises a ' || k || '.' WHEN len(aa) > 0 THEN 'Certain operations produce incorrect results.' ELSE 'Unexpected behavior has been observed.' END) AS l1 FROM s),
b AS (SELECT *, concat_ws(' ', CASE WHEN len(ms) > 0 THEN 'An issue has been identified in the ' || array_to_string(ms[:3], ', ') || ' module' || CASE WHEN len(ms) > 1 THEN 's.' ELSE '.' END END, CASE WHEN len(cs) > 0 THEN 'The issue involves the ' || array_to_string(cs[:2], ', ') || ' class' || CASE WHEN len(cs) > 1 THEN 'es.' ELSE '.' END END, CASE WHEN k <> '' AND m <> '' AND length(m) < 100 THEN 'The operation raises ' || k || ': ' || m WHEN k <> '' THEN 'A ' || k || ' is raised during processing.' END, CASE WHEN len(ts) > 0 THEN 'This affects functionality tested in ' || ts[1] || '.' END) AS l2 FROM a),
c AS (SELECT *, concat_ws(' ', CASE WHEN len(fs) > 0 AND len(ms) > 0 THEN 'The ' || array_to_string(list_transform(fs[:3], lambda x: '`' || x || '`'), ', ') || ' function' || CASE WHEN len(fs) > 1 THEN 's' ELSE '' END || ' in the ' || array_to_string(ms[:3], ', ') || ' module' || CASE WHEN len(ms) > 1 THEN 's' ELSE '' END || CASE WHEN len(fs) > 1 THEN ' exhibit' ELSE ' exhibits' END || ' incorrect behavior.' WHEN len(ms) > 0 THEN 'An issue has been identified in the ' || array_to_string(ms[:3], ', ') || ' module.' END, CASE WHEN len(cs) > 0 THEN 'The issue manifests through the ' || array_to_string(cs[:2], ', ') || ' class.' END,
  CASE WHEN k <> '' AND m <> '' THEN 'The operation raises `' || k || ': ' || m || '`.' WHEN k <> '' THEN 'A `' || k || '` is raised.' END, nullif(array_to_string(list_transform(aa[:2], lambda x: 'Observed: ' || replace(x, 'AssertionError: ', '')), ' '), ''), CASE WHEN len(ts) > 0 THEN 'This can be reproduced through tests in ' || array_to_string(ts[:3], ', ') || '.' END) AS l3 FROM b)
SELECT c_custkey, l1, CASE WHEN l2 = '' THEN l1 ELSE l2 END AS l2, CASE WHEN l3 <> '' THEN l3 WHEN l2 <> '' THEN l2 ELSE l1 END AS l3 FROM c""")
def level_texts(spark, d):
    """Problem texts of three levels from what may be told and a traceback."""
    some = lambda name, n, m: F.array_sort(F.array_distinct(F.expr(f"transform(sequence(0, c_custkey % {m}), i -> concat('{name}', (c_nationkey + i * {n}) % 10))")))
    cut = lambda a, m: F.when(F.col("c_custkey") % m == 0, F.array().cast("array<string>")).otherwise(a)
    listed = lambda name, n, m: F.array_sort(F.array_distinct(cut(F.expr(f"transform(sequence(0, greatest(c_custkey % {m} - 1, 0)), i -> concat('{name}', (c_nationkey + i * {n}) % 10))"), m)))
    del some
    told = F.struct(listed("mod", 3, 5).alias("modules"), listed("fn", 1, 6).alias("functions"), listed("Cls", 7, 3).alias("classes"))
    messages = cut(F.expr("transform(sequence(0, greatest(c_custkey % 4 - 1, 0)), i -> concat('AssertionError: ', c_mktsegment, i, ' != 3'))"), 4)
    summary = F.struct(F.expr(_SUMMARY).alias("exception_type"), F.expr(_MESSAGE).alias("exception_message"), messages.alias("assertion_messages"), listed("pkg.t", 1, 4).alias("affected_modules"))
    c = table(spark, d, "customer").select("c_custkey", told.alias("told"), summary.alias("s"))
    return c.select("c_custkey", *[problem_texts.level_text(k, F.col("told"), F.col("s")).alias(k.lower()) for k in problem_texts.LEVELS])


_PS = "concat('Order ', o_orderkey, CASE o_custkey % 4 WHEN 0 THEN ' returns a wrong total. Replace it with zero. It fails to add.' WHEN 1 THEN ' has no total! The bug is the tax.' WHEN 2 THEN concat('. It produces nothing', repeat(' again', CAST(o_custkey % 50 AS INT)), '.') ELSE '. Should use another.' END)"


_EDIT = "CASE WHEN o_custkey % 5 > 0 THEN concat('+    returns = total', o_custkey % 3, ' + ', lower(o_orderstatus), '_tax', chr(10), '-    nothing = self.wrong') END"
_PLACE = "concat('src/', lower(o_orderstatus), '_total/order/get_tax', o_custkey % 4, '.py')"
_KNOWN = "(" + ", ".join(f"'{k}'" for k in sorted(problem_texts.KEYWORDS)) + ")"


@query(f"""WITH o AS (SELECT o_orderkey, {_PS} AS t, {_EDIT} AS e, {_PLACE} AS f FROM orders), w AS (SELECT o_orderkey, unnest(regexp_extract_all(lower(t), '\\S+')) AS w FROM o), c AS (SELECT o_orderkey, w, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT o_orderkey, round(CASE WHEN sum(n) > 1 THEN log2(sum(n)) - sum(n * log2(n)) / sum(n) ELSE 0 END, 3) AS h_ps, round(count(*) / sum(n), 3) AS vocab_richness, sum(n)::BIGINT AS token_count FROM c GROUP BY 1),
i AS (SELECT o_orderkey, lower(t) AS t, list_filter(list_distinct(regexp_extract_all(coalesce(e, ''), '[A-Za-z_][A-Za-z0-9_]{{2,}}')), lambda x: x NOT IN {_KNOWN}) AS ids,
  list_distinct(list_filter(string_split(regexp_replace(regexp_extract(f, '[^/]*$'), '\\.[^.]*$', ''), '_'), lambda x: length(x) > 2) || list_transform(list_filter(string_split(f, '/'), lambda x: length(x) > 2), lambda x: replace(x, '.py', ''))) AS ws FROM o)
SELECT o_orderkey, h_ps, vocab_richness, token_count, round(CASE WHEN len(ids) = 0 THEN 0 ELSE len(list_filter(ids, lambda x: contains(t, lower(x)))) / len(ids) END, 3) AS identifier_density, round(len(list_filter(ws, lambda x: contains(t, lower(x)))) / len(ws), 3) AS chain_signal_ratio FROM m JOIN i USING (o_orderkey)""")
def text_metrics(spark, d):
    """Entropy, richness and length of problem texts, the identifiers of the patch and the words of the chain that they hold."""
    m = problem_texts.text_metrics(F.expr(_PS), F.expr(_EDIT), F.array(F.expr(_PLACE)))
    rows = table(spark, d, "orders").select("o_orderkey", m.alias("m"))
    return rows.select("o_orderkey", *[f"m.{c}" for c in ("h_ps", "vocab_richness", "identifier_density", "chain_signal_ratio")], F.col("m.token_count").cast("long").alias("token_count"))


_FAILS = "(o_custkey % 4 + CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 7 ELSE 0 END)"
_SEEN = "'Observed: ' || o_orderpriority || ' != ' || o_orderstatus"
_CLEAN = "CASE o_custkey % 4 WHEN 0 THEN 'Order ' || o_orderkey || ' returns a wrong total. It fails to add.' WHEN 1 THEN 'Order ' || o_orderkey || ' has no total!' WHEN 2 THEN 'Order ' || o_orderkey || '. It produces nothing' || repeat(' again', o_custkey % 50) || '.' ELSE 'Order ' || o_orderkey || '.' END"


@query(f"""SELECT o_orderkey, {_CLEAN} || ' ' || {_SEEN} AS hybrid, {_FAILS} || ' test(s) in pkg.mod' || o_custkey % 50 || ' are failing.' AS test_only, CASE o_custkey % 4 WHEN 0 THEN 'Order ' || o_orderkey || ' returns a wrong total. It fails to add.' WHEN 1 THEN 'Order ' || o_orderkey || ' has no total!' WHEN 2 THEN {_CLEAN} ELSE 'Order ' || o_orderkey || '.' END || ' ' || {_SEEN} || ' The operation raises: AssertionError: ' || o_orderpriority || ' != ' || o_orderstatus AS test_enhanced
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def hybrid_texts(spark, d):
    """Problem texts mixed from given texts and test output."""
    o = _outputs(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.expr(_PS).alias("ps")), "o_orderkey").select("o_orderkey", "ps", logs.parsed_output(F.col("output")).alias("p"))
    text = lambda level, mode: problem_texts.hybrid_text(F.col("ps"), F.col("p"), level, F.lit("r"), mode)
    return o.select("o_orderkey", text("standard", "hybrid").alias("hybrid"), text("minimal", "test_only").alias("test_only"), text("standard", "test_enhanced").alias("test_enhanced"))


@query(f"""WITH x AS (SELECT *, o_orderkey % 6 / 10 + 0.1 AS x FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
p AS (SELECT o_orderkey, x, concat_ws(' ', {_FAILS} || ' test(s) in pkg.mod' || o_custkey % 50 || ' are failing.', CASE WHEN x >= 0.2 THEN 'The tests report incorrect output values.' END, CASE WHEN x >= 0.4 THEN CASE o_custkey % 4 WHEN 0 THEN 'Order ' || o_orderkey || ' returns a wrong total. It fails to add.' WHEN 2 THEN 'It produces nothing' || repeat(' again', o_custkey % 50) || '.' END END, CASE WHEN x >= 0.6 THEN {_SEEN} END) AS t FROM x)
SELECT o_orderkey, CASE WHEN len(regexp_extract_all(t, '\\S+')) > floor(10 + x * 200) * 1.5 THEN array_to_string(regexp_extract_all(t, '\\S+')[1:floor(10 + x * 200)::INT], ' ') || '.' ELSE t END AS problem_statement, round(x, 2)::DOUBLE AS info_level FROM p""")
def informed_texts(spark, d):
    """Problem texts with a sliding amount of information."""
    o = _outputs(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.expr(_PS).alias("ps")), "o_orderkey").select("o_orderkey", "ps", logs.parsed_output(F.col("output")).alias("p"))
    amount = ((F.col("o_orderkey") % 6 + 1) / 10).cast("double")
    t = problem_texts.informed_text(amount, F.col("ps"), F.col("p"), F.lit("r"))
    return o.select("o_orderkey", t.alias("t")).select("o_orderkey", "t.problem_statement", "t.info_level")

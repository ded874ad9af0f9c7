"""Queries on seeds and candidates: retrieval, injection points, compatibility and the quality of defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits, injection, scalars
from ..operators import paths, quality, retrieval
from ..session import stored
from .fixtures import CODE, CODE_NODES, code_edges, code_nodes, spread, table
from .registry import query

#: A piece of code and a seed's repair for a part, as expressions that both engines read.
_CODE = """concat('def f', p_partkey, '(a, b=', p_size, '):', chr(10), CASE p_partkey % 6 WHEN 0 THEN concat('    x = r"^a', p_size, '$"') WHEN 1 THEN '    if a > b and not c:' WHEN 2 THEN '    if a is None:' WHEN 3 THEN concat('    y = str(a) + ''', p_name, '''') WHEN 4 THEN '    # nothing here' ELSE '    self.z = []' END, chr(10),
  CASE p_size % 5 WHEN 0 THEN concat('    try:', chr(10), '        go(a)', chr(10), '    except KeyError:', chr(10), '        pass') WHEN 1 THEN '    elif isinstance(a, list): return obj.run(b)' WHEN 2 THEN concat('    n = ', p_partkey) WHEN 3 THEN concat('    value_', p_size, ' = None') ELSE concat('    s = r''\\Z', p_size, '''') END)"""
_INTENT = "CASE p_partkey % 11 WHEN 0 THEN 'Constant_Update' WHEN 1 THEN 'Condition_Refinement' WHEN 2 THEN 'Guard_Clause_Addition' WHEN 3 THEN 'Argument_Update' WHEN 4 THEN 'API_Replacement' WHEN 5 THEN 'Exception_Fix' WHEN 6 THEN 'Variable_Replacement' WHEN 7 THEN 'Type_Cast_Fix' WHEN 8 THEN 'Data_Initialization' WHEN 9 THEN 'Statement_Insertion' ELSE 'Constant_Update' END"
_BEFORE = "CASE p_partkey % 9 WHEN 0 THEN concat('x = r\"a', p_size, '$\"') WHEN 1 THEN concat('if value_', p_size, ' > 3:') WHEN 2 THEN 'if a is None: return' WHEN 3 THEN concat('y = ''', p_name, '''') WHEN 4 THEN concat('n = ', p_size) WHEN 5 THEN '' WHEN 6 THEN 'call(a, key=b)' WHEN 7 THEN 'try: go()' ELSE 'while not done and ready:' END"
_AFTER = "CASE p_partkey % 9 WHEN 0 THEN concat('x = r\"a', p_size, '\\Z\"') WHEN 1 THEN concat('if value_', p_size, ' >= 3:') WHEN 2 THEN 'if a is not None: return' WHEN 3 THEN concat('y = ''', p_brand, '''') WHEN 4 THEN concat('n = ', p_size + 1) WHEN 5 THEN 'z = 1' WHEN 6 THEN 'call(b, key=a)' WHEN 7 THEN 'try: stop()' ELSE 'while not done or ready:' END"
_Q = lambda p: p.replace("'", "''")
_FIRST = lambda intent: "CASE " + " ".join(f"WHEN regexp_matches(before, '{_Q(p)}') THEN '{n}'" for n, p in injection.PATTERN_TYPES[intent]) + " ELSE 'unknown' END"
_KIND = "CASE intent " + " ".join(f"WHEN '{k}' THEN {_FIRST(k)}" for k in injection.PATTERN_TYPES) + " ELSE 'unknown' END"
_KINDS = f"p AS (SELECT *, CASE WHEN before = '' THEN 'unknown' ELSE {_KIND} END AS kind FROM p0)"
_P = f"p0 AS (SELECT p_partkey, {_CODE} AS code, {_INTENT} AS intent, {_BEFORE} AS before, {_AFTER} AS after, p_partkey % 9 = 0 AS ends FROM part), {_KINDS}"
_CAT = r"""CASE WHEN before = '' THEN '' WHEN intent = 'Constant_Update' THEN CASE WHEN regexp_matches(before, 'r[''"].*[''"]') THEN CASE WHEN ends THEN 'regex_terminator_end' ELSE 'regex_other' END WHEN regexp_matches(before, '\d+') THEN 'numeric_constant' ELSE 'string_constant' END
  WHEN intent = 'Condition_Refinement' THEN CASE WHEN contains(before, '>') OR contains(before, '<') THEN 'comparison_operator' WHEN contains(before, 'and') OR contains(before, 'or') THEN 'logical_operator' WHEN contains(before, 'not') THEN 'negation' ELSE 'condition_general' END
  WHEN intent = 'Guard_Clause_Addition' THEN CASE WHEN contains(before || after, 'None') THEN 'null_check' WHEN contains(before || after, 'isinstance') THEN 'type_check' ELSE 'validation_check' END ELSE lower(intent) END"""


def _parts(spark, d):
    rows = spread(table(spark, d, "part"), "p_partkey").select("p_partkey", *[F.expr(e.replace("\\Z", "\\\\Z")).alias(c) for c, e in (("code", _CODE), ("intent", _INTENT), ("before", _BEFORE), ("after", _AFTER))])
    return rows.withColumn("edit", edits.first_edit(F.col("before"), F.col("after")))


@query(f"WITH {_P} SELECT p_partkey, kind AS pattern_type, {_CAT} AS category FROM p")
def seed_patterns(spark, d):
    """Pattern type and category of a seed's repair."""
    edit = F.col("edit")
    blank = F.col("before") == ""
    category = F.when(blank, "").otherwise(injection.semantic_category(F.col("intent"), F.col("before"), F.col("after"), edit["old"], edit["new"]))
    return _parts(spark, d).select("p_partkey", F.when(blank, "unknown").otherwise(injection.pattern_type(F.col("intent"), F.col("before"))).alias("pattern_type"), category.alias("category"))


_RULE = lambda intent: " ".join(f"WHEN regexp_matches(line, '{_Q(p)}') THEN [{v}::VARCHAR, '{k}']" for p, k, v, _ in injection.LINE_RULES[intent])
_POINTS = rf"""l AS (SELECT p_partkey, intent, kind, {_CAT} AS cat, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS i, len(string_split(code, chr(10))) AS n FROM p),
t AS (SELECT *, max(CASE WHEN contains(line, 'try:') THEN i END) OVER w AS opened, max(CASE WHEN contains(line, 'except') AND NOT contains(line, 'try:') THEN i END) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM l WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
c AS (SELECT *, regexp_extract(line, '(r[''"][^''"]*[''"])', 1) AS lit, CASE WHEN intent = 'Constant_Update' THEN CASE WHEN kind = 'regex_literal' AND regexp_matches(line, 'r[''"][^''"]*[''"]') THEN [CASE WHEN cat = 'regex_terminator_end' THEN CASE WHEN contains(regexp_extract(line, '(r[''"][^''"]*[''"])', 1), '\Z') THEN 0.95 WHEN contains(regexp_extract(line, '(r[''"][^''"]*[''"])', 1), '$') THEN 0.85 ELSE 0.6 END ELSE 0.5 END::VARCHAR, kind]
    WHEN kind = 'string_literal' AND contains(line, '=') AND regexp_matches(line, '[''"][^''"]+[''"]') THEN ['0.6', kind] WHEN kind = 'numeric_literal' AND regexp_matches(line, '=\s*(\d+\.?\d*)') THEN ['0.6', kind] END
  WHEN intent = 'Condition_Refinement' THEN CASE WHEN regexp_matches(line, '\b(if|elif|while)\s+.+:') THEN [CASE WHEN (cat = 'comparison_operator' AND regexp_matches(line, '[<>=!]=?')) OR (cat = 'logical_operator' AND (contains(line, ' and ') OR contains(line, ' or '))) OR (cat = 'negation' AND contains(line, ' not ')) THEN '0.9' ELSE '0.7' END, 'condition'] END
  WHEN intent = 'Guard_Clause_Addition' THEN CASE WHEN regexp_matches(line, 'if\s+\w+\s+is\s+(not\s+)?None') THEN [CASE WHEN cat = 'null_check' THEN '0.9' ELSE '0.6' END, 'none_check'] WHEN regexp_matches(line, 'isinstance\s*\(') THEN [CASE WHEN cat = 'type_check' THEN '0.9' ELSE '0.6' END, 'isinstance_check'] WHEN regexp_matches(line, 'if\s+not\s+\w+') THEN ['0.7', 'empty_check'] WHEN regexp_matches(line, 'hasattr\s*\(') THEN ['0.7', 'hasattr_check'] END
  WHEN intent IN ('Argument_Update', 'Variable_Replacement') AND starts_with(ltrim(line), 'def ') THEN NULL
  WHEN intent = 'Argument_Update' THEN CASE {_RULE('Argument_Update')} END WHEN intent = 'API_Replacement' THEN CASE {_RULE('API_Replacement')} END WHEN intent = 'Variable_Replacement' THEN CASE {_RULE('Variable_Replacement')} END WHEN intent = 'Type_Cast_Fix' THEN CASE {_RULE('Type_Cast_Fix')} END WHEN intent = 'Data_Initialization' THEN CASE {_RULE('Data_Initialization')} END
  WHEN intent = 'Exception_Fix' THEN CASE WHEN contains(line, 'except') AND NOT contains(line, 'try:') AND opened > coalesce(closed, 0) THEN ['0.8', 'exception_handler'] END WHEN i = 1 THEN ['0.3', 'generic'] END AS r FROM t),
points AS (SELECT p_partkey, CASE r[2] WHEN 'exception_handler' THEN opened ELSE i END AS line_start, CASE r[2] WHEN 'generic' THEN n ELSE i END AS line_end, r[2] AS pattern_type, r[1]::DOUBLE AS score FROM c WHERE r IS NOT NULL)"""


@query(f"WITH {_P}, {_POINTS} SELECT * FROM points")
def injection_points(spark, d):
    """C11: points of a code that fit the kind of repair."""
    edit = F.col("edit")
    blank = F.col("before") == ""
    kind = F.when(blank, "unknown").otherwise(injection.pattern_type(F.col("intent"), F.col("before")))
    category = F.when(blank, "").otherwise(injection.semantic_category(F.col("intent"), F.col("before"), F.col("after"), edit["old"], edit["new"]))
    found = _parts(spark, d).select("p_partkey", F.explode(injection.injection_points(F.col("code"), F.col("intent"), kind, category)).alias("p"))
    return found.select("p_partkey", F.col("p.line_start").cast("long").alias("line_start"), F.col("p.line_end").cast("long").alias("line_end"), "p.pattern_type", "p.score")


_WORDS = "list_filter(list_distinct(regexp_extract_all(before || after, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\b', 1)), lambda x: length(x) > 2 AND lower(x) NOT IN (" + ", ".join(f"'{w}'" for w in injection.LANGUAGE_WORDS) + "))"


_TIERS = rf"""one AS (SELECT p_partkey, count(*) AS n, max(score) AS best FROM points JOIN p USING (p_partkey) WHERE score >= 0.4 AND kind <> 'unknown' GROUP BY 1),
k AS (SELECT p_partkey, len(list_filter(string_split(code, chr(10)), lambda y: NOT starts_with(trim(y), '#') AND trim(y) <> '' AND len(list_filter({_WORDS}, lambda w: contains(y, w))) > 0)) AS lines, list_max(list_transform(string_split(code, chr(10)), lambda y: CASE WHEN starts_with(trim(y), '#') THEN 0 ELSE len(list_filter({_WORDS}, lambda w: contains(y, w))) END)) AS most FROM p)"""


@query(rf"""WITH {_P}, {_POINTS}, {_TIERS}
SELECT p_partkey, CASE WHEN one.n > 0 THEN 1 WHEN lines > 0 THEN 2 WHEN len(string_split(code, chr(10))) >= 3 AND length(code) >= 50 THEN 3 END AS tier, CASE WHEN one.n > 0 THEN one.n WHEN lines > 0 THEN least(lines, 5) WHEN len(string_split(code, chr(10))) >= 3 AND length(code) >= 50 THEN 1 ELSE 0 END AS n_points, round(CASE WHEN one.n > 0 THEN best WHEN lines > 0 THEN least(0.75, 0.45 + 0.1 * most) WHEN len(string_split(code, chr(10))) >= 3 AND length(code) >= 50 THEN 0.35 END, 6)::DOUBLE AS best FROM p JOIN k USING (p_partkey) LEFT JOIN one USING (p_partkey)""")
def compatibilities(spark, d):
    """The tier at which a code fits a seed's repair."""
    c = _parts(spark, d).select("p_partkey", injection.compatibility(F.col("code"), F.col("intent"), F.col("before"), F.col("after"), F.col("edit")).alias("c"))
    return c.select("p_partkey", "c.tier", F.size("c.points").cast("long").alias("n_points"), F.round(F.array_max(F.transform("c.points", lambda p: p["score"])), 6).alias("best"))


#: Vectors belong to functions of the code graph, to that of the part with their number, wherever it lies; every eleventh to a test.
_NODE = "CASE WHEN vec_id % 11 = 3 THEN concat('tests/n', vec_id % 25, '/test_v', vec_id, '.py:test_f') ELSE concat('lib/m', vec_id % 50, '.py:f', vec_id) END"
_ANCHOR = f"CASE WHEN vec_id % 150 = 0 THEN concat('lib/m', vec_id % 50, '.py') WHEN vec_id % 350 = 200 THEN 'gone.py' ELSE {_NODE} END"
#: The columns that code and repairs are made of, from a vector's number; some functions are a line long.
_AS_PART = "vec_id AS p_partkey, CAST(vec_id % 50 + 1 AS INT) AS p_size, concat('name', vec_id) AS p_name, concat('brand', vec_id) AS p_brand"
_SHORT = f"CASE WHEN vec_id % 4 = 1 THEN concat('x', vec_id, ' = 1') ELSE {_CODE} END"


def _retrieval(spark, d, deep=True):
    """deep: with the depths of nodes, for searches that ask for them."""
    plain = lambda e: F.expr(e.replace("\\Z", "\\\\Z"))
    v = table(spark, d, "embeddings").selectExpr("*", "vec_id AS p_partkey", "cast(vec_id % 50 + 1 AS int) AS p_size", "concat('name', vec_id) AS p_name", "concat('brand', vec_id) AS p_brand")
    pool = v.select(F.col("label").alias("pool"), F.expr(_NODE).alias("node"), F.col("embedding").alias("v"), plain(_SHORT).alias("code"), F.col("vec_id").alias("idx"))
    chosen = v.where("vec_id % 50 = 0")
    seeds = chosen.select(F.col("vec_id").alias("seed"), F.col("label").alias("pool"), F.expr(_ANCHOR).alias("anchor"), (F.col("vec_id") % 3 + 2).cast("int").alias("depth"), plain(_INTENT).alias("intent"), plain(_BEFORE).alias("before"), plain(_AFTER).alias("after"), F.concat(F.lit("i"), "vec_id").alias("instance_id"), F.md5(F.col("vec_id").cast("string")).alias("commit"))
    originals = chosen.select(F.col("vec_id").alias("seed"), F.explode(F.array(F.expr(_NODE), F.expr(_NODE.replace("vec_id", "(vec_id + 10)")))).alias("node"))
    e = code_edges(spark, d)
    nodes = stored(code_nodes(e))
    depths = paths.test_depths(e, nodes, scalars.is_test_file(F.col("node"))) if deep else nodes.select("node", F.lit(paths.DEFAULT_DEPTH).alias("depth")).limit(0)
    return seeds, pool, originals, depths, e, nodes


_BASE = f"""{CODE}, {CODE_NODES}, reach(node, depth) USING KEY (node) AS (SELECT node, 0 FROM code_nodes WHERE contains(node, 'tests/') UNION SELECT e.dst, min(r.depth) + 1 FROM reach r JOIN code e ON e.src = r.node LEFT JOIN recurring.reach k ON k.node = e.dst WHERE k.node IS NULL AND r.depth < 10 GROUP BY e.dst),
v AS (SELECT vec_id, label, {_NODE} AS node, embedding::DOUBLE[] AS e, {_SHORT} AS code, {_INTENT} AS intent, {_BEFORE} AS before, {_AFTER} AS after FROM (SELECT *, {_AS_PART} FROM embeddings)),
q AS (SELECT *, vec_id % 3 + 2 AS aim, {_ANCHOR} AS anchor, CASE WHEN vec_id % 150 = 0 THEN (SELECT min(w.node) FROM v w WHERE w.label = v.label AND starts_with(w.node, 'lib/m' || v.vec_id % 50 || '.py:')) WHEN vec_id % 350 <> 200 THEN node END AS home FROM v WHERE vec_id % 50 = 0),
x AS (SELECT q.vec_id AS seed, q.home, x.vec_id, x.node, coalesce(list_dot_product(h.e, x.e) / (sqrt(list_dot_product(h.e, h.e)) * sqrt(list_dot_product(x.e, x.e)) + 1e-9), 0) AS score, CASE WHEN q.home IS NULL THEN md5(q.vec_id || '|' || x.node) ELSE '' END AS deal, x.vec_id IN (q.vec_id, q.vec_id + 10) AS original, contains(x.node, 'tests/') AS test, abs(coalesce(r.depth + 1, 3) - q.aim) > 1 AS deep, x.code, q.intent, q.before, q.after FROM q LEFT JOIN v h ON h.node = q.home JOIN v x ON x.label = q.label LEFT JOIN reach r ON r.node = x.node)"""
_NEAR = f"""near50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, deal, node) AS k FROM x WHERE NOT original AND NOT test AND NOT deep) WHERE k <= 50),
p0 AS (SELECT seed * 1000000 + vec_id AS p_partkey, code, intent, before, after, seed % 9 = 0 AS ends FROM near50), {_KINDS}, {_POINTS}, {_TIERS},
near AS (SELECT n.* FROM near50 n JOIN p ON p.p_partkey = n.seed * 1000000 + n.vec_id JOIN k ON k.p_partkey = p.p_partkey LEFT JOIN one ON one.p_partkey = p.p_partkey WHERE one.n > 0 OR k.lines > 0 OR (len(string_split(p.code, chr(10))) >= 3 AND length(p.code) >= 50))"""
_RATED = """both_ways AS (SELECT src AS a, dst AS b FROM code UNION SELECT dst, src FROM code), hubs AS (SELECT node FROM near UNION SELECT home FROM near), m AS (SELECT node AS anchor, node FROM hubs UNION SELECT a, b FROM hubs JOIN both_ways ON a = node),
inside AS (SELECT anchor, count(*) AS n FROM (SELECT DISTINCT src, dst FROM code) JOIN m ON src = node WHERE EXISTS (SELECT 1 FROM m y WHERE y.anchor = m.anchor AND y.node = dst) GROUP BY anchor),
g AS (SELECT anchor, count(*) AS n, count(*) FILTER (type = 'function') AS f, count(*) FILTER (type = 'file') AS i, count(*) FILTER (type = 'directory') AS d, count(*) FILTER (type IS NULL) AS u, coalesce(any_value(inside.n), 0) AS edges FROM m LEFT JOIN code_nodes USING (node) LEFT JOIN inside USING (anchor) GROUP BY anchor),
alike AS (SELECT seed, near.node, score, coalesce(0.7::DOUBLE * (a.f * b.f + a.i * b.i + a.d * b.d + a.u * b.u) / (sqrt(a.f * a.f + a.i * a.i + a.d * a.d + a.u * a.u) * sqrt(b.f * b.f + b.i * b.i + b.d * b.d + b.u * b.u)) + 0.3::DOUBLE * (1 - least(abs(a.edges / (a.n + 1e-9) - b.edges / (b.n + 1e-9)), 1)), 0) AS topology FROM near LEFT JOIN g a ON a.anchor = home LEFT JOIN g b ON b.anchor = near.node),
rated AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(final, 9) DESC, node) AS rank FROM (SELECT *, 0.4::DOUBLE * score + 0.6::DOUBLE * topology AS final FROM alike))"""


@query(f"""WITH RECURSIVE {_BASE}, {_NEAR}, {_RATED} SELECT seed, node, round(score, 6) AS vector_score, round(topology, 6) AS topology_score, round(final, 6) AS final_score, rank FROM rated WHERE rank <= 5""")
def candidates(spark, d):
    """Candidates by cosine, depth, compatibility and topology; tests and originals lie in the pool."""
    out = retrieval.candidates(*_retrieval(spark, d), scalars.is_test_file(F.col("node")))
    return out.select("seed", "node", *[F.round(c, 6).alias(c) for c in ("vector_score", "topology_score", "final_score")], "rank")


@query(f"""WITH RECURSIVE {_BASE}, near AS (SELECT seed, home, node, 0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || node), node) AS k FROM x WHERE NOT original AND NOT test) WHERE k <= 50), {_RATED} SELECT seed, node, round(final, 6) AS final_score, rank FROM rated WHERE rank <= 5""")
def candidate_ablations(spark, d):
    """V7: candidates by chance in place of vectors, of any depth and intent."""
    out = retrieval.candidates(*_retrieval(spark, d, deep=False), scalars.is_test_file(F.col("node")), tolerance=None, by_vector=False, by_intent=False)
    return out.select("seed", "node", F.round("final_score", 6).alias("final_score"), "rank")


_EVALUATED = f"""{_BASE.replace("LEFT JOIN v h ON h.node = q.home", "JOIN v h ON h.node = q.home")}, {_NEAR}, {_RATED},
ahead AS (SELECT x.*, row_number() OVER (PARTITION BY seed ORDER BY score DESC, node) AS place FROM x), edge AS (SELECT seed, max(place) FILTER (NOT original AND NOT test AND NOT deep) AS last, count(*) AS n FROM (SELECT *, count(*) FILTER (NOT original AND NOT test AND NOT deep) OVER (PARTITION BY seed ORDER BY place) AS had FROM ahead) WHERE had <= 50 GROUP BY seed),
had AS (SELECT seed, count(*) AS top FROM near50 GROUP BY seed),
seen AS (SELECT a.* FROM ahead a JOIN edge USING (seed) LEFT JOIN had USING (seed) WHERE coalesce(top, 0) < 50 OR place <= last),
counts AS (SELECT seed, count(*) AS scanned, count(*) FILTER (original) AS o, count(*) FILTER (test AND NOT original) AS t, count(*) FILTER (deep AND NOT test AND NOT original) AS e FROM seen GROUP BY seed),
fits AS (SELECT seed, count(*) AS n FROM near GROUP BY seed), best AS (SELECT * FROM rated WHERE rank = 1), sizes AS (SELECT label, count(*) AS n FROM v GROUP BY label),
evaluated AS (SELECT substr(md5(q.vec_id::VARCHAR), 1, 8) AS commit_short, 'i' || q.vec_id AS instance_id, md5(q.vec_id::VARCHAR) AS base_commit, anchor AS seed_node_id, coalesce(home, '') AS seed_node_resolved, CASE WHEN home IS NULL THEN 'missing' WHEN home = anchor THEN 'exact' ELSE 'file_prefix' END AS seed_resolution_mode, aim AS seed_depth, sizes.n AS embed_nodes, home IS NOT NULL AS vector_used, coalesce(h.vec_id, -1) AS seed_pool_idx,
  coalesce(scanned, 0) AS scanned, coalesce(o, 0) AS skipped_original, coalesce(t, 0) AS skipped_test_file, coalesce(c.e, 0) AS skipped_depth_mismatch, coalesce(top, 0) AS top_indices, coalesce(fits.n, 0) AS compat_nonempty, least(5, coalesce(fits.n, 0)) AS candidates, coalesce(best.node, '') AS best_anchor_node_id, round(coalesce(best.score, 0), 6) AS best_vector_score, round(coalesce(topology, 0), 6) AS best_topology_score, round(coalesce(final, 0), 6) AS best_final_score,
  CASE WHEN home IS NULL THEN 'seed_anchor_not_in_commit_map' WHEN coalesce(top, 0) = 0 THEN 'no_candidates_after_vector_filters' WHEN fits.n IS NULL THEN 'no_candidates_after_intent_compatibility' ELSE '' END AS failure_reason, 0::DOUBLE AS elapsed_s
  FROM q JOIN sizes USING (label) LEFT JOIN v h ON h.node = q.home LEFT JOIN counts c ON c.seed = q.vec_id LEFT JOIN had ON had.seed = q.vec_id LEFT JOIN fits ON fits.seed = q.vec_id LEFT JOIN best ON best.seed = q.vec_id)"""


@query(f"WITH RECURSIVE {_EVALUATED} SELECT * FROM evaluated")
def retrieval_evaluation(spark, d):
    """What the retrieval of each seed looked at, passed over and found."""
    out = retrieval.evaluation(*_retrieval(spark, d), scalars.is_test_file(F.col("node")))
    return out.withColumns({c: F.round(c, 6) for c in ("best_vector_score", "best_topology_score", "best_final_score")})


@query(f"WITH RECURSIVE {_EVALUATED} SELECT 'summary' AS kind, unnest(['total', 'ok', 'vector_missing', 'no_candidates', 'failures']) AS name, unnest([count(*), count(*) FILTER (failure_reason = ''), count(*) FILTER (NOT vector_used), count(*) FILTER (vector_used AND candidates = 0), count(*) FILTER (failure_reason <> '')]) AS n FROM evaluated UNION ALL (SELECT 'reason', failure_reason, count(*) FROM evaluated WHERE failure_reason <> '' GROUP BY failure_reason ORDER BY count(*) DESC, failure_reason LIMIT 10)")
def retrieval_summary(spark, d):
    """How many seeds found candidates, and the ten most frequent reasons of failure."""
    return retrieval.evaluation_summary(retrieval.evaluation(*_retrieval(spark, d), scalars.is_test_file(F.col("node"))))


@query("SELECT p_partkey, i AS place, CASE WHEN i = 0 THEN p_type ELSE p_brand || (i - 1) END AS intent, round(CASE WHEN i = 0 THEN 0.9 ELSE greatest(0.1, 0.7 - 0.1 * (i - 1)) END, 6)::DOUBLE AS confidence FROM part, range(0, 5) t(i) WHERE i <= p_size % 9")
def injection_suggestions(spark, d):
    """Kinds of repair to inject, with their confidence."""
    others = F.expr("transform(sequence(1, 8), i -> concat(p_brand, i - 1))")
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(injection.suggestions(F.col("p_type"), F.slice(others, F.lit(1), (F.col("p_size") % 9).cast("int")))).alias("place", "s"))
    return rows.select("p_partkey", "place", "s.intent", "s.confidence")


_PATCH = "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('--- a/x.py', chr(10), '+++ b/x.py', chr(10), repeat(concat('@@ -1 +1 @@', chr(10)), CAST(1 + o_custkey % 2 AS INT)), repeat(concat('+a = ', o_orderpriority, chr(10)), CAST(o_custkey % 14 AS INT)), repeat(concat('-b', chr(10)), CAST(o_custkey % 9 AS INT)), CASE WHEN o_custkey % 17 = 0 THEN '+    return None' ELSE '+c' END) END"
_REPORT = "CASE WHEN o_orderkey % 8 = 0 THEN 'No description' ELSE concat('Order ', o_orderkey, ' returns nothing when it is read by the customer ', o_custkey, CASE WHEN o_custkey % 3 = 0 THEN ' and raises a KeyError' ELSE '' END, CASE WHEN o_custkey % 5 = 0 THEN ', fixed by a check' ELSE '' END, repeat(' more', CAST(o_custkey % 30 AS INT))) END"
_OUT = "CASE o_custkey % 4 WHEN 0 THEN 'ValueError: x' WHEN 1 THEN 'KeyError: y' WHEN 2 THEN 'fine' END"
_METRICS = rf"""b AS (SELECT o_orderkey AS instance_id, 'own/' || o_orderpriority AS repo, o_orderstatus AS fix_intent, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey % 14 + 1 END AS added, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey % 9 END AS removed, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 + o_custkey % 2 END AS hunks, o_custkey % 17 = 0 AND o_orderkey % 9 <> 0 AS bad, {_REPORT} AS ps, CASE o_custkey % 4 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError' ELSE 'unknown' END AS mode, CASE WHEN o_custkey % 4 < 2 THEN 0.8 ELSE 0.5 END::DOUBLE AS mode_score, o_custkey % 6 AS p2f, o_custkey % 90 AS p2p, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 100 / 100 ELSE 0 END AS al FROM orders),
i AS (SELECT *, CASE WHEN p2f + p2p > 0 THEN p2f / (p2f + p2p) ELSE 0 END AS ratio, len(regexp_extract_all(ps, '\S+')) AS words FROM b),
s AS (SELECT *, CASE WHEN p2f + p2p = 0 THEN 0 WHEN ratio < 0.001 THEN 0.1 WHEN ratio <= 0.005 THEN 0.5 WHEN ratio <= 0.03 THEN 0.9 WHEN ratio <= 0.1 THEN 1 WHEN ratio <= 0.15 THEN 0.9 WHEN ratio <= 0.3 THEN 0.6 WHEN ratio <= 0.5 THEN 0.3 ELSE 0.1 END::DOUBLE AS impact, CASE WHEN added + removed = 0 THEN 0 WHEN bad THEN 0.2 WHEN added + removed <= 5 AND hunks = 1 THEN 1 WHEN added + removed <= 10 AND hunks = 1 THEN 0.9 WHEN added + removed <= 10 THEN 0.7 WHEN added + removed <= 20 THEN 0.5 ELSE 0.3 END::DOUBLE AS nat,
  CASE WHEN ps = 'No description' OR words < 10 THEN 0 ELSE round(least(1, greatest(0, 0.6 + CASE WHEN contains(ps, 'KeyError') THEN 0.2 ELSE 0 END + CASE WHEN words BETWEEN 20 AND 200 THEN 0.2 WHEN words > 200 THEN 0.1 ELSE 0 END - CASE WHEN contains(ps, 'fixed by') THEN 0.15 ELSE 0 END)), 3) END::DOUBLE AS info FROM i),
m AS (SELECT *, round(least(1, greatest(0, 0.15::DOUBLE * mode_score + 0.15::DOUBLE * impact + 0.15::DOUBLE * nat + 0.15::DOUBLE * info + 0.2::DOUBLE * al + 0.1)), 3) AS q FROM s), metrics AS (SELECT *, CASE WHEN q >= 0.7 THEN 'A' WHEN q >= 0.5 THEN 'B' WHEN q >= 0.3 THEN 'C' ELSE 'D' END AS tier FROM m)"""


def _quality(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    bugs = o.select(F.col("o_orderkey").alias("instance_id"), F.concat(F.lit("own/"), "o_orderpriority").alias("repo"), k.alias("seed_id"), F.col("o_orderstatus").alias("fix_intent"), F.lit(3).alias("chain_depth"), (k % 6).alias("p2f"), (k % 90).alias("p2p"), F.when(k % 7 != 0, k % 100 / 100).alias("chain_alignment"))
    synthesis = o.select(F.col("o_orderkey").alias("instance_id"), F.expr(_PATCH).alias("patch"), F.expr(_REPORT).alias("problem_statement"))
    outputs = o.where(k % 4 < 3).select(F.col("o_orderkey").alias("instance_id"), F.expr(_OUT).alias("output"))
    return quality.metric_table(bugs, synthesis, outputs)


@query(f"WITH {_METRICS} SELECT instance_id, repo, mode AS failure_mode, mode_score AS failure_mode_score, p2f AS p2f_count, p2p AS p2p_count, round(ratio, 6) AS test_impact_ratio, impact AS impact_ratio_score, added AS patch_added_lines, removed AS patch_removed_lines, hunks AS patch_hunk_count, bad AS patch_sabotage_detected, nat AS patch_naturalness_score, words AS ps_token_count, info AS ps_info_score, round(al, 4)::DOUBLE AS chain_alignment, q AS composite_score, tier AS quality_tier FROM metrics")
def quality_metrics(spark, d):
    """The quality of every defect."""
    keep = ["instance_id", "repo", "failure_mode", "failure_mode_score", "p2f_count", "p2p_count", "test_impact_ratio", "impact_ratio_score", "patch_added_lines", "patch_removed_lines", "patch_hunk_count", "patch_sabotage_detected", "patch_naturalness_score", "ps_token_count", "ps_info_score", "chain_alignment", "composite_score", "quality_tier"]
    longs = ("patch_added_lines", "patch_removed_lines", "patch_hunk_count", "ps_token_count")
    return _quality(spark, d).select(*[F.col(c).cast("long").alias(c) if c in longs else F.col(c) for c in keep])


@query(f"""WITH {_METRICS}, r AS (SELECT 'all' AS scope, '' AS name, q AS v, tier FROM metrics UNION ALL SELECT 'repo', repo, q, tier FROM metrics UNION ALL SELECT 'intent', fix_intent, q, tier FROM metrics),
w AS (SELECT scope, name, count(*) AS n, round(avg(v), 6) AS mean, round(count(*) FILTER (tier = 'A') / count(*), 6) AS share_a, round(count(*) FILTER (tier = 'B') / count(*), 6) AS share_b, round(count(*) FILTER (tier = 'C') / count(*), 6) AS share_c, round(count(*) FILTER (tier = 'D') / count(*), 6) AS share_d FROM r GROUP BY ALL),
x AS (SELECT name, v FROM (UNPIVOT (SELECT mode_score AS failure, impact, nat AS patch, info AS text, round(al, 4)::DOUBLE AS alignment FROM metrics) ON failure, impact, patch, text, alignment INTO NAME name VALUE v))
SELECT * FROM w UNION ALL SELECT 'dimension', name, count(*), round(avg(v), 6), NULL, NULL, NULL, NULL FROM x GROUP BY name""")
def quality_report(spark, d):
    """The composite over all, by repository, by intent and by dimension."""
    return quality.report(_quality(spark, d))


@query(f"WITH {_METRICS} SELECT mode AS failure_mode, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, mode) AS rank FROM metrics GROUP BY mode QUALIFY rank <= 10")
def top_failure_modes(spark, d):
    """A5: the ten most frequent kinds of failure."""
    return quality.top_modes(_quality(spark, d))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'sklearn' WHEN s_suppkey % 5 = 1 THEN s_name ELSE s_name || '-' || s_nationkey END AS repo FROM supplier")
def short_repos(spark, d):
    """short names of repositories."""
    r = F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'scikit-learn/scikit-learn' WHEN 1 THEN s_name ELSE concat('org', s_nationkey, '/', s_name, '-', s_nationkey) END")
    return table(spark, d, "supplier").select("s_suppkey", quality.short_repo(r).alias("repo"))


_RESULT = "CASE event_id % 5 WHEN 0 THEN concat('{\"chain_alignment_score\": {\"structural_alignment\": {\"overall_score\": ', value, '}, \"overall_score\": 0.1}}') WHEN 1 THEN concat('{\"chain_alignment_score\": {\"overall_score\": ', value, '}}') WHEN 2 THEN '{\"chain_alignment_score\": 7}' WHEN 3 THEN '{}' ELSE concat('{\"chain_alignment_score\": {\"structural_alignment\": {}, \"overall_score\": ', user_id, '}}') END"


@query("SELECT event_id, round(CASE WHEN event_id % 5 < 2 THEN value WHEN event_id % 5 < 4 THEN 0 ELSE user_id END, 6)::DOUBLE AS alignment FROM events")
def stored_alignments(spark, d):
    """the alignment of a stored validation result, new form first."""
    return table(spark, d, "events").select("event_id", F.round(quality.stored_alignment(F.expr(_RESULT)), 6).alias("alignment"))

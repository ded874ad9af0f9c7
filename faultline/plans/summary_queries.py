"""Queries that sum up runs, texts of levels, localizations and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries
from ..sources import report_set
from .fixtures import table
from .graph_queries import _RINGS, _rings
from .registry import query


def _mean(x: str, n: str = "") -> str:
    return f"coalesce(sum(CAST({x} AS DECIMAL(28,10)))::DOUBLE / nullif({n or f'count({x})'}, 0), 0)"


@query("""WITH r AS (SELECT c_nationkey AS repo, CASE o_orderkey % 7 WHEN 0 THEN 'invalid' WHEN 1 THEN 'missing_image' WHEN 2 THEN 'timeout' WHEN 3 THEN 'crashed' WHEN 4 THEN NULL ELSE 'valid' END AS status, o_orderkey % 7 > 4 AND o_orderstatus = 'F' AS is_valid FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT repo, count(*) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'missing_image') AS missing_image, count(*) FILTER (status = 'timeout') AS timeout, count(*) FILTER (status IS NULL OR status = 'crashed') AS error, count(*) FILTER (is_valid) AS valid_bugs, printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (is_valid) / count(*)) AS success_rate FROM r GROUP BY 1""")
def run_totals(spark, d):
    """A3: runs by loose status, missing images among them, and the rate of valid defects."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("repo")), "o_custkey")
    k = F.col("o_orderkey") % 7
    status = F.when(k == 0, "invalid").when(k == 1, "missing_image").when(k == 2, "timeout").when(k == 3, "crashed").when(k > 4, "valid")
    return summaries.run_totals(o.select("repo", status.alias("status"), ((k > 4) & (F.col("o_orderstatus") == "F")).alias("is_valid")), ["repo"])


_SEVEN = {"tokens": "l_quantity", "entropy": "l_discount", "richness": "l_tax", "density": "l_partkey % 100 / 100.0", "patch_entropy": "l_suppkey % 10 / 7.0", "overlap": "CASE WHEN l_linenumber < 4 THEN l_linenumber END", "signal": "l_extendedprice / 1000"}


@query("WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN TRUE WHEN l_returnflag = 'A' THEN FALSE END AS resolved, " + ", ".join(f"({e})::DOUBLE AS {m}" for m, e in _SEVEN.items()) + f"), l AS (UNPIVOT r ON {', '.join(_SEVEN)} INTO NAME metric VALUE v), m AS (SELECT metric, {_mean('v')} AS m, {_mean('CASE WHEN resolved THEN v END')} AS t, {_mean('CASE WHEN NOT resolved THEN v END')} AS f FROM l GROUP BY 1) SELECT metric, round(m, 6) AS mean, round(t, 6) AS mean_true, round(f, 6) AS mean_false, round(t - f, 6) AS delta, abs(t - f) > 0.02 AS notable FROM m".replace("), l AS", " FROM lineitem), l AS"))
def compared_metrics(spark, d):
    """Means of seven metrics over all, the resolved and the unresolved, and their differences."""
    flag = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    rows = table(spark, d, "lineitem").select(flag.alias("resolved"), *[F.expr(f"CAST({e} AS DOUBLE)").alias(m) for m, e in _SEVEN.items()])
    return summaries.compared_groups(rows, "resolved", list(_SEVEN))


@query(f"""WITH g AS (SELECT l_orderkey, {', '.join(f"max(CASE WHEN l_linenumber = {i} THEN l_discount END)::DOUBLE AS l{i}" for i in (1, 2, 3))}, (count(*) FILTER (l_returnflag = 'R'))::DOUBLE / 7 AS original FROM lineitem GROUP BY 1)
SELECT o_orderpriority AS fix_intent, count(*) AS n, {', '.join(f"round({_mean(c)}, 6) AS {c}" for c in ("l1", "l2", "l3"))}, round({_mean("CASE WHEN o_custkey % 3 > 0 THEN original END", "count(*)")}, 6) AS original, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS resolved_pct FROM orders JOIN g ON o_orderkey = l_orderkey GROUP BY 1""")
def intent_means(spark, d):
    """By kind of repair, means of the density on three levels and of the original text (0 where there is none), and the share that was resolved."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.max(F.when(F.col("l_linenumber") == i, F.col("l_discount"))).cast("double").alias(f"l{i}") for i in (1, 2, 3)], (F.count_if(F.col("l_returnflag") == "R") / 7.0).cast("double").alias("original"))
    rows = table(spark, d, "orders").join(li, "o_orderkey").select(F.col("o_orderpriority").alias("fix_intent"), "l1", "l2", "l3", F.when(F.col("o_custkey") % 3 > 0, F.col("original")).alias("original"), (F.col("o_orderstatus") == "F").alias("resolved"))
    return summaries.grouped_means(rows, ["fix_intent"], ["l1", "l2", "l3", "original"], "resolved", ("original",))


@query(f"""WITH t AS (SELECT 'L' || (l_linenumber % 3 + 1) AS level, l_suppkey % 5 AS model, l_quantity::DOUBLE AS tokens, CASE WHEN l_quantity < 40 THEN l_discount::DOUBLE END AS density, l_tax::DOUBLE AS entropy, (CASE WHEN l_linestatus = 'F' THEN l_partkey % 7 END)::DOUBLE / 7 AS signal FROM lineitem)
SELECT model, level, count(*) AS n, {', '.join(f"round({_mean(c)}, 6) AS {c}" for c in ("tokens", "density", "entropy", "signal"))} FROM t GROUP BY ALL""")
def level_means(spark, d):
    """Four metrics of texts by model and level; texts without a metric are left out of its mean."""
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("L"), (F.col("l_linenumber") % 3 + 1).cast("string")).alias("level"), (F.col("l_suppkey") % 5).alias("model"), q.cast("double").alias("tokens"), F.when(q < 40, F.col("l_discount").cast("double")).alias("density"), F.col("l_tax").cast("double").alias("entropy"), (F.when(F.col("l_linestatus") == "F", F.col("l_partkey") % 7).cast("double") / 7).alias("signal"))
    return summaries.grouped_means(rows, ["model", "level"], ["tokens", "density", "entropy", "signal"])


_FOUND = {"true_files": ("l_suppkey", "l_linenumber <= 2"), "true_entities": ("l_partkey", "l_linenumber <= 2"), "static_files": ("l_suppkey", "l_linenumber % 2 = 0"), "static_entities": ("l_partkey", "l_linenumber % 2 = 0"), "traced_files": ("l_suppkey", "l_quantity > 25"), "traced_entities": ("l_partkey", "l_quantity > 25 AND l_linenumber <> 3")}
_FOUND_SQL = "f AS (SELECT l_orderkey, min(l_suppkey) % 4 AS repo, " + ", ".join(f"coalesce(list(DISTINCT {c}) FILTER ({w}), []) AS {n}" for n, (c, w) in _FOUND.items()) + " FROM lineitem GROUP BY 1)"


def _found(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey")
    return g.agg((F.min("l_suppkey") % 4).alias("repo"), *[F.collect_set(F.expr(f"CASE WHEN {w} THEN {c} END")).alias(n) for n, (c, w) in _FOUND.items()])


@query(f"""WITH {_FOUND_SQL}, m AS (SELECT 'static' AS method, true_files, true_entities, static_files AS files, static_entities AS entities FROM f UNION ALL SELECT 'traced', true_files, true_entities, traced_files, traced_entities FROM f),
s AS (SELECT method, CASE WHEN len(true_files) = 0 THEN 0 ELSE len(list_intersect(true_files, files)) / len(true_files) END AS c, CASE WHEN len(true_entities) = 0 THEN 0 ELSE len(list_intersect(true_entities, entities)) / len(true_entities) END AS e FROM m)
SELECT method, count(*) AS n, round({_mean('c')}, 6) AS file_coverage, round({_mean('e')}, 6) AS entity_overlap FROM s GROUP BY 1""")
def compared_methods(spark, d):
    """The mean coverage of true files and overlap of true entities of two methods of localization."""
    return summaries.compared_methods(_found(spark, d), ["static", "traced"])


@query(f"WITH {_FOUND_SQL} SELECT count(*) AS n, count(*) FILTER (len(traced_files) > 0) AS with_files, round({_mean('len(traced_files)', 'count(*)')}, 6) AS mean_files, round({_mean('len(traced_entities)', 'count(*)')}, 6) AS mean_functions, count(*) FILTER (len(list_intersect(traced_files, true_files)) > 0) AS covered FROM f WHERE repo <> 1")
def located_outside(spark, d):
    """What was found in all repositories but the default one, and how often a true file was among it."""
    rows = _found(spark, d).select(F.col("repo").cast("string").alias("repo"), F.col("traced_files").alias("found_files"), F.col("traced_entities").alias("functions"), "true_files")
    return summaries.located_outside(rows, "1")


_TYPE = "CASE WHEN length(node) % 2 = 0 THEN 'function' ELSE 'class' END AS type"
_TEXT = "CASE WHEN length(node) % 3 > 0 THEN concat('def f_', node, '(a, b=1):', chr(10), '    return a +  b') END AS code"
_PROFILES = f"""WITH RECURSIVE {_RINGS}, closed AS (SELECT g, src, dst FROM e UNION SELECT c.g, c.src, e.dst FROM closed c JOIN e ON e.g = c.g AND e.src = c.dst),
n0 AS (SELECT g, src::VARCHAR AS node FROM e UNION SELECT g, dst::VARCHAR FROM e), n AS (SELECT g, node, {_TYPE}, {_TEXT} FROM n0),
w AS (SELECT g, src::VARCHAR AS a, dst::VARCHAR AS b FROM e UNION SELECT g, dst::VARCHAR, src::VARCHAR FROM e),
cc(g, node, c) USING KEY (g, node) AS (SELECT g, node, node FROM n0 UNION SELECT w.g, w.b, min(cc.c) FROM cc JOIN w ON w.g = cc.g AND w.a = cc.node JOIN recurring.cc k ON k.g = w.g AND k.node = w.b WHERE cc.c < k.c GROUP BY w.g, w.b),
x AS (SELECT DISTINCT g, src::VARCHAR AS src, dst::VARCHAR AS dst FROM e), i AS (SELECT g, dst AS node, count(*) AS i FROM x GROUP BY ALL), o AS (SELECT g, src AS node, count(*) AS o FROM x GROUP BY ALL),
y AS (SELECT n.*, coalesce(i, 0) AS i, coalesce(o, 0) AS o, len(regexp_extract_all(coalesce(code, ''), '\\w+|[^\\w\\s]')) AS tokens, length(coalesce(code, '')) AS chars FROM n LEFT JOIN i USING (g, node) LEFT JOIN o USING (g, node)),
p AS (SELECT g AS graph, count(*) AS n_nodes, sum(o)::BIGINT AS n_edges, round(sum(o)::DOUBLE / (count(*) * (count(*) - 1)), 6) AS density, g NOT IN (SELECT g FROM closed WHERE src = dst) AS is_dag, (SELECT count(DISTINCT c) FROM cc WHERE cc.g = y.g) AS n_components, round(sum(o)::DOUBLE / count(*), 6) AS mean_degree, max(i)::BIGINT AS max_in, max(o)::BIGINT AS max_out,
  count(*) FILTER (o = 0) AS n_leaves, coalesce(sum(tokens) FILTER (o = 0), 0)::BIGINT AS leaf_tokens, round(coalesce(sum(tokens) FILTER (o = 0)::DOUBLE / count(*) FILTER (o = 0), 0), 6) AS mean_leaf_tokens, count(*) FILTER (type = 'function') AS n_functions, round(coalesce(sum(chars) FILTER (type = 'function')::DOUBLE / count(*) FILTER (type = 'function'), 0), 6) AS mean_function_chars FROM y GROUP BY g)"""


def _graphs(spark, d):
    e = _rings(spark, d)
    nodes = e.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.selectExpr("graph", "node", _TYPE, _TEXT), e


@query(_PROFILES + " SELECT * FROM p")
def graph_profiles(spark, d):
    """Sizes, degrees, components, leaves and code of every graph."""
    return summaries.graph_profiles(*_graphs(spark, d))


@query(_PROFILES + f" SELECT count(*) AS graphs, sum(n_nodes)::BIGINT AS nodes, sum(n_edges)::BIGINT AS edges, round({_mean('n_nodes')}, 6) AS mean_nodes, round({_mean('n_edges')}, 6) AS mean_edges FROM p")
def graph_totals(spark, d):
    """Totals and means over many graphs."""
    return summaries.graph_totals(*_graphs(spark, d))


def _chains(spark, d):
    """A conversation is a chain of its turns."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], F.lit(":"), x["turn"].cast("string"))).alias("nodes"))
    k = F.col("conv_id")
    return c.select(k.alias("chain_id"), (k % 40).alias("instance_id"), F.when(k % 5 > 0, F.concat(F.lit("r"), (k % 5).cast("string"))).alias("repo"), F.when(k % 3 == 1, "").when(k % 3 == 2, F.concat(F.lit("t"), (k % 7).cast("string"))).alias("fix_intent"), F.when(k % 11 > 0, F.col("nodes")).alias("nodes"))


@query("""WITH c AS (SELECT conv_id, list(role || ':' || turn ORDER BY turn, role) AS nodes FROM conversations GROUP BY 1)
SELECT conv_id AS chain_id, conv_id % 40 AS seed_instance_id, CASE WHEN conv_id % 5 > 0 THEN 'r' || conv_id % 5 ELSE 'Unknown' END AS repo, CASE conv_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['Unknown'] ELSE ['t' || conv_id % 7] END AS fix_intents,
  CASE WHEN conv_id % 11 > 0 THEN len(nodes) ELSE 0 END AS path_length, CASE WHEN conv_id % 11 > 0 THEN nodes[1] ELSE 'N/A' END AS symptom_node, CASE WHEN conv_id % 11 > 0 THEN nodes[-1] ELSE 'N/A' END AS root_cause_node FROM c""")
def chain_summaries(spark, d):
    """The summary of extracted chains."""
    return report_set.chain_summaries(_chains(spark, d))


@query("""SELECT (SELECT count(*) FROM customer) AS total_input_instances, (SELECT count(DISTINCT conv_id) FROM conversations) AS total_extracted_chains, (SELECT count(*) FROM orders) AS total_synthetic_instances, (SELECT count(DISTINCT o_custkey) FROM orders) AS seeds_with_synthetic,
  printf('%.1f%%', 100.0::DOUBLE * (SELECT count(DISTINCT o_custkey) FROM orders) / (SELECT count(*) FROM customer)) AS seed_coverage_rate, round((SELECT count(*) FROM orders)::DOUBLE / (SELECT count(*) FROM customer), 3) AS avg_synthetic_per_seed""")
def run_report(spark, d):
    """The totals of a run, seeds without a defect among them."""
    seeds, defects = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("seed_id"))
    return report_set.run_report(seeds, _chains(spark, d), defects)


@query("""WITH f AS (SELECT o_custkey AS instance, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 * 100 ELSE 999999 END AS rank, epoch_us(o_orderdate::TIMESTAMP) AS us, 'run/' || CASE WHEN o_orderkey % 4 > 0 THEN 'i_rank_' || o_custkey || '_rank' || o_orderkey % 9 * 100 ELSE 'i_rank_' || o_custkey END || '.json' AS path FROM orders)
SELECT 'i_rank_' || instance AS instance_id, arg_min(rank, (rank, -us, path))::BIGINT AS rank, arg_min(path, (rank, -us, path)) AS path FROM f GROUP BY instance""")
def best_details(spark, d):
    """The best result file of each instance by the rank in its name, files without one last."""
    path = F.expr("concat('run/i_rank_', o_custkey, CASE WHEN o_orderkey % 4 > 0 THEN concat('_rank', o_orderkey % 9 * 100) ELSE '' END, '.json')")
    return report_set.best_details(table(spark, d, "orders").select(path.alias("path"), F.col("o_orderdate").cast("timestamp").alias("mtime"))).select("instance_id", "rank", "path")

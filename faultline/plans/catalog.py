"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import graph, ranks, tables, topk
from . import answer_queries, chain_queries, command_queries, gate_queries, graph_queries, log_queries, repository_queries, seed_queries, summary_queries, table_queries, text_queries  # noqa: F401  (they register themselves)
from .fixtures import EDGES, RUNS, chains, edges, runs, table
from .registry import ORACLES, QUERIES, query  # noqa: F401

FLAGSHIP = "candidates"


_TOK = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_TOK}) AS n_tokens, round(CASE WHEN len({_TOK}) = 0 THEN 0 ELSE len(list_distinct(list_transform({_TOK}, lambda x: lower(x)))) / len({_TOK}) END, 6) AS ttr FROM documents")
def token_measures(spark, d):
    """token count and type-token ratio of reports."""
    return table(spark, d, "documents").select("doc_id", F.size(s.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.round(s.type_token_ratio(F.col("text")), 6).alias("ttr"))


@query(f"""WITH w AS (SELECT item_id, unnest(list_transform({_TOK}, lambda x: lower(x))) AS w FROM benchmark), c AS (SELECT item_id, w, count(*) AS n FROM w GROUP BY ALL)
SELECT item_id, round(CASE WHEN sum(n) > 1 THEN log2(sum(n)) - sum(n * log2(n)) / sum(n) ELSE 0 END, 6) AS entropy FROM c GROUP BY item_id""")
def word_entropy(spark, d):
    """Shannon entropy of words."""
    words = table(spark, d, "benchmark").select("item_id", F.explode(s.tokens(F.lower("text"))).alias("w"))
    return tables.entropy(words, "item_id", "w").select("item_id", F.round("entropy", 6).alias("entropy"))


_PATH = "CASE page_id % 13 WHEN 0 THEN concat('Src/Tests/a', page_id, '.py:X') WHEN 1 THEN concat('src/test_', page_id, '.py') WHEN 2 THEN concat('src/mod', page_id, '_tests.py') WHEN 3 THEN concat('src/contest/x', page_id, '.py') WHEN 4 THEN concat('lib/testing/h', page_id, '.py:f') WHEN 5 THEN 'conftest.py' WHEN 6 THEN concat('x', page_id, '/tests.py:f') WHEN 7 THEN concat('a/latest', page_id, '.py') WHEN 8 THEN concat('a', page_id, '/TEST.py') WHEN 9 THEN concat('x/y', page_id, '_test.py:C.m') WHEN 10 THEN concat('pkg/m', page_id, '.py:test_f') WHEN 11 THEN concat('testing/t', page_id, '.py') ELSE concat('a/attest', page_id, '/b.py') END"


@query(f"""SELECT page_id, url, contains(p, 'tests/') OR contains(p, 'test/') OR contains(p, '/testing/') OR starts_with(n, 'test_') OR n LIKE '%\\_test.py' ESCAPE '\\' OR n LIKE '%\\_tests.py' ESCAPE '\\' OR n IN ('tests.py', 'conftest.py', 'test.py') AS is_test
FROM (SELECT page_id, url, p, list_extract(string_split(p, '/'), -1) AS n FROM (SELECT page_id, url, lower(string_split({_PATH}, ':')[1]) AS p FROM pages))""")
def test_file_predicate(spark, d):
    """Does a path belong to a test?"""
    return table(spark, d, "pages").select("page_id", "url", s.is_test_file(F.expr(_PATH)).alias("is_test"))


@query("SELECT doc_id, md5(trim(text)) AS hash, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_ \\t\\n\\r\\f\\x0B]')) AS n_code_tokens FROM documents")
def text_hash(spark, d):
    """content hash and code-token count."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.trim("text")).alias("hash"), s.code_tokens(F.col("text")).cast("long").alias("n_code_tokens"))


@query(f"""WITH t AS (SELECT item_id, text, len({_TOK}) AS n, regexp_matches(text, '(?i)\\b(when|instead of|expected|returns|produces|should|fails to)\\b') AS b,
  regexp_matches(text, '(?i)\\b(Error|Exception|TypeError|ValueError|AssertionError|raises|fails with|traceback)\\b') AS e,
  regexp_matches(text, '(?i)\\b(the fix is|fixed by|should be changed to|replace .+ with)\\b')::INT + regexp_matches(text, '(?i)\\b(use .+ instead of|change .+ to|switching from .+ to)\\b')::INT + regexp_matches(text, '(?i)\\b(needs to be|should use)\\b')::INT AS l FROM benchmark)
SELECT item_id, n AS token_count, b AS has_behavioral_desc, e AS has_error_desc, n < 10 AS is_fallback, l AS leak_count,
  CASE WHEN n < 10 THEN 0 ELSE round(greatest(0, least(1, 0.3::DOUBLE + CASE WHEN b THEN 0.3 ELSE 0 END + CASE WHEN e THEN 0.2 ELSE 0 END + CASE WHEN n BETWEEN 20 AND 200 THEN 0.2 WHEN n > 200 THEN 0.1 ELSE 0 END - 0.15 * l)), 3) END::DOUBLE AS info_score FROM t""")
def report_informativeness(spark, d):
    """how much a report tells."""
    return table(spark, d, "benchmark").select("item_id", s.report_informativeness(F.col("text")).alias("r")).select("item_id", F.col("r.token_count").cast("long").alias("token_count"), "r.has_behavioral_desc", "r.has_error_desc", "r.is_fallback", F.col("r.leak_count").cast("int").alias("leak_count"), "r.info_score")


@query(f"WITH {RUNS} SELECT instance, test, pre, post, category FROM moved")
def test_transitions(spark, d):
    """The last status in each phase, tests of both phases, classified."""
    return tables.transitions(tables.last_status(runs(spark, d), ["instance", "test", "phase"], ["ts", "event_id"])).select("instance", "test", "pre", "post", "category")


@query(f"""WITH {RUNS}, c AS (SELECT instance, count(*) FILTER (category = 'FAIL_TO_PASS') AS fail_to_pass, count(*) FILTER (category = 'PASS_TO_FAIL') AS pass_to_fail, count(*) FILTER (category = 'PASS_TO_PASS') AS pass_to_pass, count(*) FILTER (category = 'FAIL_TO_FAIL') AS fail_to_fail FROM moved GROUP BY instance)
SELECT *, CASE WHEN pass_to_fail > 0 AND pass_to_pass > 0 THEN 'valid' ELSE 'invalid' END AS status, pass_to_fail > 0 AND pass_to_pass > 0 AND fail_to_fail = 0 AND fail_to_pass = 0 AS is_valid_bug FROM c""")
def validation_status(spark, d):
    """The verdict of each instance."""
    moved = tables.transitions(tables.last_status(runs(spark, d), ["instance", "test", "phase"], ["ts", "event_id"]))
    return tables.verdicts(moved)


@query("""WITH q AS (SELECT o_orderkey, count(*) FILTER (l_returnflag = 'R') AS p2f, count(*) FILTER (l_returnflag <> 'R') AS p2p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), r AS (SELECT *, p2f / (p2f + p2p) AS ratio FROM q), i AS (
SELECT *, CASE WHEN ratio < 0.001 THEN 0.1 WHEN ratio <= 0.005 THEN 0.5 WHEN ratio <= 0.03 THEN 0.9 WHEN ratio <= 0.1 THEN 1.0 WHEN ratio <= 0.15 THEN 0.9 WHEN ratio <= 0.3 THEN 0.6 WHEN ratio <= 0.5 THEN 0.3 ELSE 0.1 END::DOUBLE AS score FROM r),
s AS (SELECT *, round(least(1, greatest(0, 0.15::DOUBLE * 0.5 + 0.15::DOUBLE * score + 0.15::DOUBLE * 0.9 + 0.15::DOUBLE * ratio + 0.2::DOUBLE * 0.75 + 0.1)), 3) AS quality FROM i)
SELECT o_orderkey, p2f, p2p, round(ratio, 6) AS ratio, score, quality, CASE WHEN quality >= 0.7 THEN 'A' WHEN quality >= 0.5 THEN 'B' WHEN quality >= 0.3 THEN 'C' ELSE 'D' END AS tier FROM s""")
def impact_and_composite(spark, d):
    """the share of broken tests, its score, the composite and its tier."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    q = o.select("o_orderkey").join(l.select("l_orderkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("p2f"), F.count_if(F.col("l_returnflag") != "R").alias("p2p"))
    ratio, score = s.impact(F.col("p2f"), F.col("p2p"))
    q = q.select("*", ratio.alias("r"), score.alias("score"))
    quality, _ = s.composite(F.lit(0.5), F.col("score"), F.lit(0.9), F.col("r"), F.lit(0.75))
    q = q.withColumn("quality", quality)
    tier = F.when(F.col("quality") >= 0.7, "A").when(F.col("quality") >= 0.5, "B").when(F.col("quality") >= 0.3, "C").otherwise("D")
    return q.select("o_orderkey", "p2f", "p2p", F.round("r", 6).alias("ratio"), "score", "quality", tier.alias("tier"))


@query(f"WITH {EDGES} SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY node")
def node_degrees(spark, d):
    """Degrees."""
    return graph.degrees(edges(spark, d))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
p AS (SELECT q.vec_id AS seed, v.vec_id AS candidate, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)) + 1e-9) AS score FROM q JOIN v USING (label) WHERE q.vec_id <> v.vec_id)
SELECT seed, candidate, round(score, 6) AS score, row_number() OVER (PARTITION BY seed ORDER BY round(score, 6) DESC, candidate) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, candidate) AS k FROM p) WHERE k <= 5""")
def retrieval(spark, d):
    """The five nearest candidates of each seed within its label, by blocks."""
    v = table(spark, d, "embeddings")
    pool = v.select(F.col("label").alias("pool"), F.col("vec_id").alias("node"), F.col("embedding").alias("v"))
    seeds = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("seed"), F.col("label").alias("pool"), F.col("embedding").alias("v"))
    none = F.lit(None).cast("double")
    name = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")  # noqa: E731  these sort as their numbers do
    asking = seeds.withColumns({"aim": none, "skip": F.array(name("seed"))})
    named = pool.select("pool", name("node").alias("node"), "v", none.alias("depth"), F.lit(False).alias("test"))
    pairs = topk.nearest(asking, named, 5).select("seed", F.col("node").cast("long").alias("candidate"), F.round("score", 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "candidate"))
    return pairs.withColumn("rank", rank)


@query("""WITH c AS (SELECT conv_id AS chain_id, turn AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT chain_id, pos, CASE WHEN k = n THEN 'root_cause' WHEN k = 1 THEN 'symptom' ELSE 'intermediate' END AS node_type FROM c""")
def node_types(spark, d):
    """Node types by position."""
    return tables.typed_by_position(chains(spark, d), "chain_id", "pos").select("chain_id", "pos", "node_type")


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'symptom' WHEN 'assistant' THEN 'root_cause' ELSE 'intermediate' END AS t FROM conversations), a AS (SELECT conv_id // 2 AS pair, turn AS pos, t AS ta FROM c WHERE conv_id % 2 = 0), b AS (SELECT conv_id // 2 AS pair, turn AS pos, t AS tb FROM c WHERE conv_id % 2 = 1),
j AS (SELECT pair, count(ta) AS na, count(tb) AS nb, count(*) FILTER (ta = tb) AS same FROM a FULL JOIN b USING (pair, pos) GROUP BY pair)
SELECT pair, na, nb, same, round(1 - abs(na - nb) / greatest(na, nb), 6) AS depth_match, round(same / greatest(na, nb), 6) AS structure_similarity, round(0.4::DOUBLE * (1 - abs(na - nb) / greatest(na, nb)) + 0.4::DOUBLE * (same / greatest(na, nb)), 6) AS partial_score FROM j""")
def chain_alignment(spark, d):
    """Chains aligned by position."""
    c = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 2).alias("pair"), (F.col("conv_id") % 2).alias("side"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "symptom").when(F.col("role") == "assistant", "root_cause").otherwise("intermediate").alias("node_type"))
    return tables.chain_alignment(c.where("side = 0"), c.where("side = 1"))


@query("""WITH r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2 AS rx, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS ry FROM customer)
SELECT c_mktsegment, count(*) AS n, round(1 - 6 * sum((rx - ry) ** 2) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS rho FROM r GROUP BY 1""")
def spearman(spark, d):
    """Rank correlation with shared ranks."""
    out = ranks.spearman(table(spark, d, "customer"), "c_acctbal", "c_nationkey", ["c_mktsegment"])
    return out.select("c_mktsegment", "n", F.round("rho", 6).alias("rho"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority, o_orderstatus) AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority, o_orderstatus), (o_orderpriority))")
def status_counts(spark, d):
    """A1: status counts in all and by group, in one pass."""
    p, t = "o_orderpriority", "o_orderstatus"
    sets = table(spark, d, "orders").groupingSets([[t], [p, t], [p]], p, t)
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id(p, t).cast("long").alias("level"))


@query("SELECT event_type AS model, count(*) AS calls, sum(floor(value))::BIGINT AS input_tokens, sum(user_id)::BIGINT AS output_tokens, round(sum(floor(value)) / 1e6 * 0.574::DOUBLE + sum(user_id) / 1e6 * 2.294::DOUBLE, 6) AS cost FROM events GROUP BY ROLLUP (event_type)")
def usage_cost(spark, d):
    """Usage and default-rate cost by model, and in all."""
    e = table(spark, d, "events").select(F.col("event_type").alias("model"), F.floor("value").alias("i"), F.col("user_id").alias("o"))
    return e.rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.round(F.sum("i") / F.lit(1e6) * 0.574 + F.sum("o") / F.lit(1e6) * 2.294, 6).alias("cost"))


@query("""WITH o AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o)
SELECT user_id, event_type, max(n) AS longest FROM (SELECT user_id, event_type, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL""")
def consecutive_failures(spark, d):
    """The longest run of one event type for each user."""
    r = tables.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "event_type", "__run").agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("user_id", "event_type").agg(F.max("n").alias("longest"))


@query("SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3")
def last_turns(spark, d):
    """The last three turns."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", back.alias("back")).where("back <= 3")


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS std FROM orders GROUP BY 1")
def describe(spark, d):
    """Mean, median and sample deviation."""
    out = ranks.described(table(spark, d, "orders").select("o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice")
    return out.select("o_orderstatus", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")])


@query("SELECT floor((p_retailprice - 900) / 50)::BIGINT AS bin, p_brand, count(*) AS n FROM part GROUP BY ALL")
def histogram(spark, d):
    """A histogram by group."""
    return table(spark, d, "part").groupBy(F.floor((F.col("p_retailprice") - 900) / 50).alias("bin"), "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n < 15 THEN 'Other' ELSE p_type END AS grp, sum(n)::BIGINT AS n, count(*) AS kinds FROM c GROUP BY 1")
def other_bucket(spark, d):
    """Small groups folded into one."""
    c = table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(F.when(F.col("n") < 15, "Other").otherwise(F.col("p_type")).alias("grp")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def left_with_defaults(spark, d):
    """Left join with defaults, originals excluded."""
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(labels.where("toxic = 1"), "doc_id", "left_anti").join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query(f"WITH t AS (SELECT item_id, list_distinct({_TOK}) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def set_similarity(spark, d):
    """Jaccard of token sets of neighbouring items."""
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(s.tokens(F.col("text"))).alias("w"))
    b = t.select(F.col("item_id").alias("b"), (F.col("item_id") - 1).alias("a"), F.col("w").alias("v"))
    return t.select(F.col("item_id").alias("a"), "w").join(b, "a").select("a", "b", F.round(s.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))

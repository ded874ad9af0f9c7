"""Queries on joins, aggregates, ranks, sets and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, ranks, stats
from .fixtures import EDGES, edges, table
from .registry import query


@query("""WITH s AS (SELECT p_brand, p_partkey AS span, p_size * 10 AS a, p_size * 10 + p_partkey % 90 AS b FROM part), l AS (SELECT DISTINCT p_brand, p_partkey % 600 AS line FROM part)
SELECT l.p_brand, l.line, arg_min(span, (b - a, span)) AS span FROM l LEFT JOIN s ON l.p_brand = s.p_brand AND line BETWEEN a AND b GROUP BY ALL""")
def innermost_entity(spark, d):
    """The smallest span that holds a line."""
    p = table(spark, d, "part")
    spans = p.select("p_brand", F.col("p_partkey").alias("span"), (F.col("p_size") * 10).alias("a"), (F.col("p_size") * 10 + F.col("p_partkey") % 90).alias("b"))
    lines = p.select("p_brand", (F.col("p_partkey") % 600).alias("line")).distinct()
    return stats.innermost(lines, spans, ["p_brand"], "line", "a", "b", "span")


@query("SELECT c_mktsegment, list_sort(list(c_acctbal))[count(*) // 2 + 1] AS upper_median FROM customer GROUP BY 1")
def upper_medians(spark, d):
    """The upper median."""
    return ranks.medians(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal").select("c_mktsegment", "upper_median")


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rank FROM lineitem")
def shared_ranks(spark, d):
    """Ranks in three groups that hold the whole table, ties by their mean."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return ranks.average_rank(rows, "l_quantity", "rank", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "rank")


@query("""SELECT l_linestatus, round((avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R')) * sqrt(count(*) FILTER (l_returnflag = 'R') * count(*) FILTER (l_returnflag <> 'R') / (count(*) * count(*))) / stddev_samp(l_quantity), 6) AS r,
round((avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R')) / stddev_pop(l_quantity), 6) AS d FROM lineitem GROUP BY 1""")
def effect_sizes(spark, d):
    """Point-biserial correlation and Cohen's d."""
    flag, v = F.col("l_returnflag") == "R", F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(stats.point_biserial(flag, v), 6).alias("r"), F.round(stats.cohens_d(flag, v), 6).alias("d"))


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE rank <= 3")
def top_failures(spark, d):
    """The three most frequent kinds of each group."""
    return stats.top_by_count(table(spark, d, "part"), ["p_brand"], "p_type", 3)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(DISTINCT o_custkey) AS seeds FROM orders GROUP BY 1")
def tier_pivot(spark, d):
    """A4, A10: tiers by group, and distinct seeds."""
    tier = lambda x: F.count_if(F.col("o_orderstatus") == x).alias(x)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(tier("F"), tier("O"), tier("P"), F.count_distinct("o_custkey").alias("seeds"))


@query("SELECT metric, round(avg(v) FILTER (l_returnflag = 'R') - avg(v) FILTER (l_returnflag <> 'R'), 6) AS delta FROM (UNPIVOT (SELECT l_returnflag, l_quantity::DOUBLE AS quantity, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax FROM lineitem) ON quantity, discount, tax INTO NAME metric VALUE v) GROUP BY metric")
def group_deltas(spark, d):
    """Differences of means of two groups over several metrics, in one pass."""
    long = table(spark, d, "lineitem").select("l_returnflag", F.expr("stack(3, 'quantity', double(l_quantity), 'discount', double(l_discount), 'tax', double(l_tax)) AS (metric, v)"))
    r = F.col("l_returnflag") == "R"
    return long.groupBy("metric").agg(F.round(F.avg(F.when(r, F.col("v"))) - F.avg(F.when(~r, F.col("v"))), 6).alias("delta"))


@query("SELECT coalesce(s_nationkey, c_nationkey) AS nation, coalesce(e, 0) AS expected, coalesce(a, 0) AS actual, coalesce(a, 0) >= coalesce(e, 0) AS complete FROM (SELECT s_nationkey, count(*) AS e FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS a FROM customer WHERE c_acctbal > 0 GROUP BY 1) ON s_nationkey = c_nationkey")
def expected_actual(spark, d):
    """A2: expected and actual counts of each group."""
    e = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("e"))
    a = table(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("a"))
    e0, a0 = F.coalesce("e", F.lit(0)), F.coalesce("a", F.lit(0))
    return e.join(a, "nation", "full").select("nation", e0.alias("expected"), a0.alias("actual"), (a0 >= e0).alias("complete"))


@query("""WITH o AS (SELECT o_orderkey, list_sort(list_distinct(list(l_partkey % 20))) AS a, list_sort(list_distinct(list(l_suppkey % 20))) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey, len(list_intersect(a, b)) AS shared, len(a) - len(list_intersect(a, b)) AS only_a, len(b) - len(list_intersect(a, b)) AS only_b, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS overlap FROM o""")
def set_overlaps(spark, d):
    """Shared and one-sided members, and the overlap."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey") % 20).alias("a"), F.collect_set(F.col("l_suppkey") % 20).alias("b"))
    n = lambda c: F.size(c).cast("long")
    both = n(F.array_intersect("a", "b"))
    return g.select("o_orderkey", both.alias("shared"), n(F.array_except("a", "b")).alias("only_a"), n(F.array_except("b", "a")).alias("only_b"), F.round(both / F.greatest(n("a"), F.lit(1)), 6).alias("overlap"))


@query("SELECT c_nationkey AS k, c_mktsegment AS v FROM customer EXCEPT ALL SELECT s_nationkey, 'BUILDING' FROM supplier")
def multiset_difference(spark, d):
    """Difference of multisets."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v")).exceptAll(table(spark, d, "supplier").select("s_nationkey", F.lit("BUILDING")))


@query("SELECT l_partkey AS k, arg_min(l_linestatus, (l_linenumber, l_orderkey, l_linestatus)) AS mode, min(l_linenumber) AS source FROM lineitem GROUP BY 1")
def first_sources(spark, d):
    """The first source of each key wins."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("source"), "l_orderkey", F.col("l_linestatus").alias("mode"))
    return stats.first_source(rows, "k", ["source", "l_orderkey"]).select("k", "mode", "source")


@query("SELECT DISTINCT md5(concat(p_name, '|', p_brand, '|', p_size)) AS hash FROM part WHERE md5(concat(p_name, '|', p_brand, '|', p_size)) NOT IN (SELECT md5(concat(p_name, '|', p_brand, '|', p_size)) FROM part WHERE p_partkey % 2 = 0)")
def new_hashes(spark, d):
    """Distinct contents that the pool lacks."""
    h = table(spark, d, "part").select("p_partkey", F.md5(F.concat_ws("|", "p_name", "p_brand", "p_size")).alias("hash"))
    return h.select("hash").distinct().join(h.where("p_partkey % 2 = 0").select("hash"), "hash", "left_anti")


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY hits DESC, o_totalprice DESC, o_orderkey) AS rank
FROM (SELECT *, (o_orderpriority = '1-URGENT')::INT AS hits, max((o_orderpriority = '1-URGENT')::INT) OVER (PARTITION BY o_custkey) AS best FROM orders) WHERE best = 0 OR hits > 0)""")
def reranked(spark, d):
    """Candidates with hits if a seed has any, else all, ranked by several keys."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("hits"))
    w = Window.partitionBy("o_custkey")
    kept = o.withColumn("best", F.max("hits").over(w)).where("best = 0 or hits > 0")
    return kept.select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy(F.desc("hits"), F.desc("o_totalprice"), "o_orderkey")).alias("rank"))


@query("SELECT s_nationkey, s_suppkey, (row_number() OVER w - 1) // 3 AS chunk, (row_number() OVER w - 1) % 4 AS worker FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)")
def chunks(spark, d):
    """Groups cut into chunks, and dealt to workers in turn."""
    k = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long") - 1
    return table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.floor(k / 3).alias("chunk"), (k % 4).alias("worker"))


@query("WITH c AS (SELECT conv_id, turn, len(text) AS n FROM conversations) SELECT a.conv_id, count(*) FILTER (a.n > b.n) AS inversions, count(*) AS pairs FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1")
def inversions(spark, d):
    """Ordered pairs of frames that stand in the wrong order; arrays hold one trace."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("a"))
    later = lambda x, i: F.size(F.filter(F.slice("a", i + 2, F.size("a")), lambda y: y < x))
    total = F.aggregate(F.transform("a", later), F.lit(0), lambda s, x: s + x).cast("long")
    return g.where(F.size("a") > 1).select("conv_id", total.alias("inversions"), (F.size("a").cast("long") * (F.size("a") - 1) / 2).cast("long").alias("pairs"))


@query("WITH t AS (SELECT l_orderkey AS o_orderkey, l_linenumber, coalesce(bool_and(l_returnflag = 'R') FILTER (l_returnflag <> 'N'), false) AS ok FROM lineitem GROUP BY ALL) SELECT o_orderkey, count(*) AS total, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM t GROUP BY 1")
def resolution_rate(spark, d):
    """Expected tests that pass; tests without a status failed."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    done = li.where("l_returnflag <> 'N'").select("o_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "PASSED").otherwise("FAILED").alias("status"))
    return stats.resolution(li.select("o_orderkey", "l_linenumber"), done, "o_orderkey", "l_linenumber")


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'a' WHEN contains(p_type, 'PROMO') THEN 'b' WHEN contains(p_type, 'BRASS') THEN 'c' END AS price FROM part")
def first_matches(spark, d):
    """The first pattern in table order."""
    return stats.first_match(table(spark, d, "part").select("p_partkey", "p_type"), [("STEEL", "a"), ("PROMO", "b"), ("BRASS", "c")], F.col("p_type"), "price").select("p_partkey", "price")


@query("SELECT c_custkey, o IS NOT NULL AS submitted, coalesce(o, 'no_submission') AS status FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS o FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def submissions(spark, d):
    """Every instance with its submission, or the default."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("o"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.col("o").isNotNull().alias("submitted"), F.coalesce("o", F.lit("no_submission")).alias("status"))


@query("SELECT c_mktsegment AS model, c_nationkey % 3 AS level, count(*) AS total, count(*) FILTER (c_acctbal > 5000) AS resolved, round(100.0::DOUBLE * count(*) FILTER (c_acctbal > 5000) / count(*), 4) AS rate FROM customer GROUP BY ALL")
def model_levels(spark, d):
    """Totals and rates by model and level."""
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("model"), (F.col("c_nationkey") % 3).alias("level"))
    n, hit = F.count(F.lit(1)), F.count_if(F.col("c_acctbal") > 5000)
    return g.agg(n.alias("total"), hit.alias("resolved"), F.round(F.lit(100.0) * hit / n, 4).alias("rate"))


@query(f"WITH {EDGES}, e AS (SELECT src, dst, type FROM edges UNION ALL SELECT src, dst, 'imports' FROM edges WHERE type = 'contains') SELECT src, dst, CASE WHEN bool_or(type = 'invokes') THEN 'invokes' ELSE 'imports' END AS type FROM e GROUP BY src, dst")
def simple_graph(spark, d):
    """Parallel edges collapsed, the later type wins."""
    e = edges(spark, d).select("src", "dst", "type")
    more = e.where("type = 'contains'").withColumn("type", F.lit("imports"))
    return graph.collapse(e.unionByName(more)).select("src", "dst", "type")


@query(f"""WITH {EDGES}, d AS (SELECT node, sum(i) AS i, sum(o) AS o FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY 1)
SELECT count(*) AS n_nodes, sum(o)::BIGINT AS n_edges, max(i + o)::BIGINT AS max_degree, count(*) FILTER (o = 0) AS n_leaves, round(sum(o) / (count(*) * (count(*) - 1)), 6) AS density FROM d""")
def graph_stats(spark, d):
    """Size, density, largest degree and leaves of one graph."""
    return graph.stats(edges(spark, d))

"""Queries on answers of models and tools, test labels, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers, labels
from ..operators import reports
from .fixtures import spread, table
from .registry import query

_N = "CAST(floor(value) AS BIGINT)"
_LIST = f"CASE event_id % 6 WHEN 0 THEN concat('[\"', event_type, '\", \"', user_id, '\"]') WHEN 1 THEN concat(' ', event_type, ' ') WHEN 2 THEN '' WHEN 3 THEN '[broken' WHEN 4 THEN '[]' ELSE concat('[\"a\", null, \"', {_N}, '\"]') END"


@query(f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN [event_type, user_id::VARCHAR] WHEN 1 THEN [event_type] WHEN 3 THEN ['[broken'] WHEN 5 THEN ['a', ({_N})::VARCHAR] ELSE [] END AS items FROM events")
def tolerant_lists(spark, d):
    """lists given as JSON, as a bare text or not at all."""
    return table(spark, d, "events").select("event_id", answers.tolerant_list(F.expr(_LIST)).alias("items"))


_OBJECT = f"concat('{{\"kind\": \"', event_type, '\", \"n\": ', {_N}, '}}')".replace("{{", "{").replace("}}", "}")
_ANSWER = f"CASE event_id % 6 WHEN 0 THEN concat('Here it is: ```json', chr(10), {_OBJECT}, chr(10), '``` done.') WHEN 1 THEN {_OBJECT} WHEN 2 THEN concat('so ', {_OBJECT}, ' that') WHEN 3 THEN 'no object' WHEN 4 THEN concat('{{\"kind\": \"a\\\\d', event_type, '\", \"n\": ', {_N}, '}}') ELSE concat('{{\"a\": ', {_OBJECT}, '}} and more') END".replace("{{", "{").replace("}}", "}")


@query(f"SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN event_type WHEN event_id % 6 = 4 THEN 'a\\d' || event_type WHEN event_id % 6 = 5 THEN NULL END AS kind, CASE WHEN event_id % 6 IN (0, 1, 2, 4) THEN {_N} END AS n, event_id % 6 <> 3 AS found, CASE WHEN event_id % 6 IN (0, 1, 2, 5) THEN event_type END AS ladder FROM events")
def json_answers(spark, d):
    """JSON objects in answers, in fences and prose, with stray backslashes."""
    # chr(92) is a backslash, which literals of the two engines write in different ways
    text = F.expr(_ANSWER.replace("a\\\\d", "a', chr(92), 'd"))
    rows = table(spark, d, "events").select("event_id", answers.json_in(text).alias("a"), answers.json_by_ladder(text).alias("b"))
    return rows.select("event_id", F.get_json_object("a", "$.kind").alias("kind"), F.get_json_object("a", "$.n").cast("long").alias("n"), F.col("a").isNotNull().alias("found"), F.get_json_object("b", "$.kind").alias("ladder"))


_TURN = f"""CASE event_id % 5 WHEN 0 THEN concat('<thought> look at ', {_N}, ' </thought> <action>read_', event_type, '</action> <action_input>{{"n": ', {_N}, '}}</action_input>') WHEN 1 THEN concat('Thought: maybe ', {_N}, chr(10), 'Action: find_', event_type, chr(10), 'Action Input: {{"n": ', {_N}, '}} trailing }}')
  WHEN 2 THEN concat('I think ', {_N}, chr(10), '### Action: run_', event_type, chr(10), '```json', chr(10), '{{"n": ', {_N}, '}}', chr(10), '```') WHEN 3 THEN concat('<thought>x', {_N}, '</thought><action>: stop_', event_type, chr(10), '<action_input>: {{"n": ', {_N}, '}}}}') ELSE concat('only words ', {_N}) END""".replace("{{", "{").replace("}}", "}")


@query(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'look at ' || {_N} WHEN 1 THEN 'maybe ' || {_N} WHEN 2 THEN 'I think ' || {_N} WHEN 3 THEN 'x' || {_N} ELSE 'only words ' || {_N} END AS thought, CASE event_id % 5 WHEN 0 THEN 'read_' || event_type WHEN 1 THEN 'find_' || event_type WHEN 2 THEN 'run_' || event_type WHEN 3 THEN 'stop_' || event_type ELSE '' END AS action, CASE WHEN event_id % 5 < 4 THEN {_N} END AS n FROM events")
def agent_turns(spark, d):
    """thought, action and input of answers in tags or under headings."""
    t = table(spark, d, "events").select("event_id", answers.agent_turn(F.expr(_TURN)).alias("t"))
    thought = F.regexp_replace("t.thought", r"\s*###\s*$", "")
    return t.select("event_id", thought.alias("thought"), "t.action", F.get_json_object("t.input", "$.n").cast("long").alias("n"))


@query("SELECT p_partkey, k::VARCHAR AS number, 'text ' || k || ' of ' || p_name AS text FROM part, range(1, 4) t(k) WHERE k <= 1 + p_size % 3")
def answer_variants(spark, d):
    """numbered variants of an answer, in two layouts, the first of each number."""
    one = F.expr("transform(sequence(1, 1 + p_size % 3), k -> concat('**Transform Kind ', k, '** ', chr(10), 'text ', k, ' of ', p_name, ' ', chr(10)))")
    again = F.concat(one, F.array(F.lit("**Transform Kind 1** late")))
    text = F.when(F.col("p_partkey") % 2 == 0, F.array_join(again, "-----------\n")).otherwise(F.concat(F.lit("Sure.\n"), F.array_join(again, "\n")))
    return table(spark, d, "part").select("p_partkey", F.explode(answers.variants(text)).alias("v")).select("p_partkey", "v.number", "v.text")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'mod.' || lower(c_mktsegment) END AS module, CASE WHEN c_custkey % 4 < 2 THEN 'Case' || c_nationkey END AS class, CASE WHEN c_custkey % 4 < 2 THEN 'test_' || c_custkey END AS method FROM customer")
def unittest_ids(spark, d):
    """module, class and method of a unit test's name."""
    text = F.expr("CASE WHEN c_custkey % 4 < 2 THEN concat('test_', c_custkey, ' (mod.', lower(c_mktsegment), '.Case', c_nationkey, ')') WHEN c_custkey % 4 = 2 THEN concat('Docs say so ... (mod.T', c_custkey, ')') ELSE concat('test_', c_custkey, ' (bare)') END")
    return table(spark, d, "customer").select("c_custkey", answers.unittest_id(text).alias("u")).select("c_custkey", "u.module", "u.class", "u.method")


_LINES = "list_transform(range(1, 6), lambda i: 'line ' || i || ' of ' || p_name || CASE WHEN i = 3 THEN p_partkey ELSE i END)"


@query(rf"""SELECT p_partkey, array_to_string({_LINES}, chr(10)) AS code FROM part""")
def clean_snippets(spark, d):
    """F32: code without the line numbers before its lines."""
    code = F.expr("array_join(transform(sequence(1, 5), i -> concat('  ', i + 40, ' | line ', i, ' of ', p_name, CASE WHEN i = 3 THEN p_partkey ELSE i END, '  ')), chr(10))")
    return table(spark, d, "part").select("p_partkey", answers.without_line_numbers(code).alias("code"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 + p_size % 9 WHEN 1 THEN 2 + p_size % 9 WHEN 2 THEN 4 END AS line FROM part")
def located_snippets(spark, d):
    """where a snippet begins in a file, white space apart, whole or in part."""
    content = "transform(sequence(1, 14), i -> concat(repeat(' ', i), 'step', i * 7919 + 13 * i * i, '(', p_name, ')'))"
    whole = "array_join(slice({c}, 1 + cast(p_size % 9 as int), 4), chr(10))".format(c=content)
    part = "array_join(concat(slice({c}, 2 + cast(p_size % 9 as int), 3), array('other = 1')), chr(10))".format(c=content)
    half = "array_join(transform(sequence(4, 7), i -> concat('step', i * 7919 + 13 * i * i, CASE WHEN i = 4 THEN '' ELSE concat('(', p_name, ')') END)), chr(10))"
    snippet = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN {whole} WHEN 1 THEN {part} WHEN 2 THEN {half} ELSE 'nothing here' END")
    found = answers.locate(snippet, F.expr(f"array_join({content}, chr(10))"), F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") % 9).cast("int")).otherwise(0))
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", found.alias("line"))


@query("""SELECT p_partkey, 'diff --git a/src/m' || p_size || '.py b/src/m' || p_size || '.py' || chr(10) || '--- a/src/m' || p_size || '.py' || chr(10) || '+++ b/src/m' || p_size || '.py' || chr(10) || '@@ -' || greatest(1, k - 3) || ',' || (least(9, k + 3) - greatest(1, k - 3) + 1) || ' +' || greatest(1, k - 3) || ',' || (least(9, k + 3) - greatest(1, k - 3) + 1) || ' @@' || chr(10)
  || array_to_string(list_transform(range(greatest(1, k - 3), k), lambda i: ' row ' || i), chr(10)) || CASE WHEN k > 1 THEN chr(10) ELSE '' END || '-row ' || k || chr(10) || '+new ' || p_name || chr(10) || array_to_string(list_transform(range(k + 1, least(9, k + 3) + 1), lambda i: ' row ' || i || chr(10)), '') AS patch FROM (SELECT *, 1 + p_size % 9 AS k FROM part)""")
def built_patches(spark, d):
    """patches with three lines of context from a changed line of a file."""
    k = F.expr("cast(1 + p_size % 9 as int)")
    content = F.concat(F.array_join(F.expr("transform(sequence(1, 9), i -> concat('row ', i))"), "\n"), F.lit("\n"))
    patch = answers.built_patch(F.expr("concat('src/m', p_size, '.py')"), content, F.concat(F.lit("row "), k), F.concat(F.lit("new "), "p_name"), k)
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", patch.alias("patch"))


_USAGE = "concat('[{\"steps\": [{\"model\": \"m', user_id % 5, '\", \"prompt_tokens\": ', event_id, ', \"completion_tokens\": ', user_id, ', \"cache_read_input_tokens\": ', event_id % 40, '}, {\"deep\": {\"model\": \"big-m', user_id % 3, '\", \"input\": ', user_id, ', \"output\": 3, \"timestamp\": \"t', event_id % 7, '\"}}], \"prompt\": {\"model\": \"x\", \"input\": 1}}, {\"model\": \"none\"}]')"


@query("""WITH r AS (SELECT 'm' || user_id % 5 AS model, event_id AS i, user_id AS o, event_id % 40 AS c, '' AS t FROM events UNION ALL SELECT 'big-m' || user_id % 3, user_id, 3, 0, 't' || event_id % 7 FROM events), u AS (SELECT model, i, o, t, min(c) AS c FROM r GROUP BY ALL),
p AS (SELECT *, CASE WHEN contains(model, 'm1') THEN 1.5 WHEN contains(model, 'big') THEN 8 END::DOUBLE AS rate FROM u)
SELECT model, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(CASE WHEN rate IS NULL THEN i * 574 + o * 2294 ELSE CAST(rate * 100 AS BIGINT) * (10 * greatest(0, i - c) + c + 50 * o) END)::DECIMAL(30, 0) / 1000000000::DECIMAL(30, 0), 6)::DOUBLE AS cost FROM p GROUP BY ROLLUP (model)""")
def usage_costs(spark, d):
    """Usage anywhere in JSON, each record once, at the first rate whose name the model holds, by model and in all."""
    found = table(spark, d, "events").select(F.explode(answers.usage_of(F.expr(_USAGE))).alias("u")).select("u.*")
    rates = spark.createDataFrame([(0, "m1", 1.5, 1.5, 0.15, 7.5), (1, "big", 8.0, 8.0, 0.8, 40.0)], "ord int, name string, input double, cache_write double, cache_read double, output double")
    return reports.usage_costs(found, rates)


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'sympy/sympy' WHEN 1 THEN 'psf/requests' WHEN 2 THEN 'generic' WHEN 3 THEN 'astropy/astropy' WHEN 4 THEN 'sphinx-doc/sphinx' ELSE 'generic' END AS profile, 'img.own_1776_' || s_name || '.' || substr(md5(s_name), 1, 8) AS image FROM supplier")
def repo_profiles(spark, d):
    """Profiles of repositories, exact, by part or generic, and images with a commit."""
    repo = F.expr("CASE s_suppkey % 6 WHEN 0 THEN ' Sympy/SymPy ' WHEN 1 THEN concat('fork-of-psf/requests-', s_suppkey) WHEN 2 THEN concat('own/', s_name) WHEN 3 THEN 'astropy' WHEN 4 THEN 'sphinx-doc/sphinx' ELSE concat(s_name, '/x') END")
    image = labels.image_with_commit(F.concat(F.lit("own/"), "s_name"), F.md5("s_name"), "img.")
    return table(spark, d, "supplier").select("s_suppkey", labels.profile_of(repo).alias("profile"), image.alias("image"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'm' || c_nationkey || '.tests.Case.test_' || c_custkey WHEN 1 THEN 'a' || c_nationkey || '.test_' || c_custkey WHEN 2 THEN 'src.t' || c_custkey ELSE 'plain' || c_custkey END AS dotted, CASE c_custkey % 4 WHEN 0 THEN 'm' || c_nationkey || '.tests' WHEN 1 THEN 'a' || c_nationkey || '.test_' || c_custkey WHEN 2 THEN 'src.t' || c_custkey ELSE 'plain' || c_custkey END AS module FROM customer")
def test_labels(spark, d):
    """test ids and paths as dotted labels, and labels cut to their module."""
    t = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('tests/m', c_nationkey, '/tests.py::Case::test_', c_custkey) WHEN 1 THEN concat('./tests/a', c_nationkey, '/test_', c_custkey, '.py') WHEN 2 THEN concat('src/t', c_custkey, '.py') ELSE concat('plain', c_custkey) END")
    dotted = labels.to_dotted(t)
    return table(spark, d, "customer").select("c_custkey", dotted.alias("dotted"), labels.collapse_label(dotted).alias("module"))


@query("""WITH m AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'pkg' || l_suppkey % 3 WHEN 1 THEN 'pkg' || l_suppkey % 3 || '.mod' || l_partkey % 4 ELSE CASE WHEN l_quantity > 10 THEN 'pkg' || l_suppkey % 3 || '.mod' || l_partkey % 4 || '.Case' ELSE ' ' END END AS x FROM lineitem), u AS (SELECT DISTINCT l_orderkey, trim(x) AS x FROM m WHERE trim(x) <> ''), k AS (SELECT * FROM u WHERE contains(x, '.') OR l_orderkey NOT IN (SELECT l_orderkey FROM u WHERE contains(x, '.')))
SELECT l_orderkey, list_sort(list(x)) AS modules FROM k WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.l_orderkey = k.l_orderkey AND starts_with(y.x, k.x || '.')) GROUP BY 1""")
def pruned_modules(spark, d):
    """Test modules without those below which others lie."""
    x = F.expr("CASE l_linenumber % 3 WHEN 0 THEN concat('pkg', l_suppkey % 3) WHEN 1 THEN concat('pkg', l_suppkey % 3, '.mod', l_partkey % 4) ELSE CASE WHEN l_quantity > 10 THEN concat('pkg', l_suppkey % 3, '.mod', l_partkey % 4, '.Case') ELSE ' ' END END")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(x).alias("a"))
    return g.select("l_orderkey", F.array_sort(labels.pruned(F.col("a"))).alias("modules")).where(F.size("modules") > 0)


@query("""SELECT p_partkey, CASE WHEN contains(f, 'lib/m1') THEN ['a', 'b'] WHEN contains(f, 'm12.py') THEN ['c'] WHEN contains(f, '/core/') THEN ['d'] WHEN contains(f, '/tests/') THEN [f] ELSE ['lib/m' || p_size || '/tests/test_f' || p_partkey || '.py'] END AS modules FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'lib/m' || p_size || '/core/f' || p_partkey || '.py' WHEN 1 THEN 'lib/m' || p_size || '/tests/f' || p_partkey || '.py' ELSE 'lib/m' || p_size || '/__f' || p_partkey || '.py' END AS f FROM part)""")
def mapped_tests(spark, d):
    """Tests of source files by the first pattern of a mapping, else by convention."""
    f = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('lib/m', p_size, '/core/f', p_partkey, '.py') WHEN 1 THEN concat('lib/m', p_size, '/tests/f', p_partkey, '.py') ELSE concat('lib/m', p_size, '/__f', p_partkey, '.py') END")
    mapping = spark.createDataFrame([(0, "lib/m1", ["a", "b"]), (1, "m12.py", ["c"]), (2, "/core/", ["d"])], "ord int, pattern string, modules array<string>")
    return labels.mapped_tests(table(spark, d, "part").select("p_partkey", f.alias("source")), mapping).select("p_partkey", "modules")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN o_orderstatus || chr(10) WHEN o_custkey % 5 = 1 THEN o_orderpriority ELSE o_orderpriority || chr(10) || o_orderstatus || chr(10) END AS patch FROM orders")
def joined_patches(spark, d):
    """Two patches in one."""
    a, b = F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")), F.when(F.col("o_custkey") % 5 != 1, F.concat("o_orderstatus", F.lit("\n"))).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", labels.joined_patches(a, b).alias("patch"))


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey % 6) FILTER (l_returnflag = 'R') AS f, list(DISTINCT l_suppkey % 6) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS k, list_sort(list(DISTINCT l_partkey % 9)) AS s FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, coalesce(f, []) AS f, s, list_sort(list_filter(coalesce(k, []), lambda x: NOT list_contains(coalesce(f, []), x))) AS left_over FROM g)
SELECT l_orderkey, CASE WHEN len(left_over) > 0 THEN left_over ELSE list_filter(s, lambda x: NOT list_contains(f, x))[:5] END AS tests FROM x""")
def disjoint_tests(spark, d):
    """Tests that stay passing, without those that are to fail, filled up from spare ones."""
    s = lambda c, cond=None: F.array_sort(F.collect_set(c if cond is None else F.when(cond, c)))
    six, r = F.col("l_suppkey") % 6, F.col("l_returnflag") == "R"
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(s(six, r).alias("f"), s(six, ~r & (F.col("l_linestatus") == "F")).alias("k"), s(F.col("l_partkey") % 9).alias("s"))
    return g.select("l_orderkey", labels.disjoint_tests(F.col("f"), F.col("k"), F.col("s")).alias("tests"))


@query("""WITH g AS (SELECT l_orderkey, coalesce(list(DISTINCT 't' || l_suppkey) FILTER (l_returnflag = 'R'), []) AS e, coalesce(list(DISTINCT 't' || l_partkey % 100) FILTER (l_linestatus = 'F'), []) AS p, count(*) FILTER (l_quantity > 40) AS f FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(e) > 0 THEN len(list_filter(e, lambda x: len(list_filter(p, lambda y: contains(x, y) OR contains(y, x))) = 0)) = 0 ELSE f = 0 END AS resolved FROM g""")
def verdicts(spark, d):
    """C17: is every expected test among the passed ones, by either name?"""
    s = lambda c, cond: F.collect_set(F.when(cond, c))
    t = lambda c: F.concat(F.lit("t"), c.cast("string"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(s(t(F.col("l_suppkey")), F.col("l_returnflag") == "R").alias("e"), s(t(F.col("l_partkey") % 100), F.col("l_linestatus") == "F").alias("p"), s(F.col("l_partkey"), F.col("l_quantity") > 40).alias("f"))
    return g.select("l_orderkey", labels.resolved(F.col("e"), F.col("p"), F.col("f")).alias("resolved"))


_CANDIDATES = "c AS (SELECT o_custkey AS seed, o_orderkey AS node, o_orderkey AS place, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey % 3 ELSE 0 END AS hits, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 4 ELSE 0 END AS related, o_totalprice AS score FROM orders)"


@query(f"""WITH {_CANDIDATES}, b AS (SELECT *, max(hits) OVER w AS h, max(related) OVER w AS r FROM c WINDOW w AS (PARTITION BY seed)), k AS (SELECT * FROM b WHERE CASE WHEN h > 0 THEN hits > 0 WHEN r > 0 THEN related > 0 ELSE true END)
SELECT 'filter' AS mode, seed, node, row_number() OVER (PARTITION BY seed ORDER BY hits DESC, related DESC, score DESC, node) AS rank FROM k UNION ALL SELECT 'rank_only', seed, node, row_number() OVER (PARTITION BY seed ORDER BY hits DESC, related DESC, score DESC, node) FROM c UNION ALL SELECT 'off', seed, node, row_number() OVER (PARTITION BY seed ORDER BY place) FROM c""")
def ranked_candidates(spark, d):
    """Candidates ranked by their tests, in the three modes."""
    hit = lambda cond, m: F.when(cond, F.col("o_orderkey") % m).otherwise(0)
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("seed"), F.col("o_orderkey").alias("node"), F.col("o_orderkey").alias("place"), hit(F.col("o_orderpriority") == "1-URGENT", 3).alias("hits"), hit(F.col("o_orderstatus") == "F", 4).alias("related"), F.col("o_totalprice").alias("score"))
    each = [labels.ranked_candidates(c, m).select(F.lit(m).alias("mode"), "seed", "node", "rank") for m in ("filter", "rank_only", "off")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("""WITH r AS (SELECT o_orderkey AS instance, o_orderpriority AS repo, CASE o_orderstatus WHEN 'F' THEN 'valid' WHEN 'O' THEN 'invalid' ELSE 'missing_image' END AS status, o_orderstatus = 'F' AND o_custkey % 3 > 0 AS bug FROM orders)
SELECT repo, status, count(*) AS n, count(*) FILTER (bug) AS valid_bugs FROM r GROUP BY GROUPING SETS ((repo, status), (repo), (status), ())""")
def validation_summary(spark, d):
    """A1, A3: statuses and valid defects over all and by repository, in one pass."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "invalid").otherwise("missing_image")
    return reports.validation_summary(o.select(F.col("o_orderpriority").alias("repo"), status.alias("status"), ((status == "valid") & (F.col("o_custkey") % 3 > 0)).alias("is_valid_bug")))


@query("""SELECT o_orderpriority AS model, o_orderstatus AS level, count(*) AS total, count(*) FILTER (o_custkey % 4 > 0) AS submitted, count(*) FILTER (o_custkey % 4 > 0 AND o_custkey % 7 = 0) AS resolved, count(*) FILTER (o_custkey % 4 = 1 AND o_custkey % 5 = 0) AS errors, count(*) FILTER (o_custkey % 4 > 0 AND o_custkey % 7 = 0) || '/' || count(*) || ' (' || format('{:.1f}', round(100 * count(*) FILTER (o_custkey % 4 > 0 AND o_custkey % 7 = 0) / count(*), 1)) || '%)' AS resolve_rate FROM orders GROUP BY ALL""")
def evaluation_summary(spark, d):
    """Submitted, resolved and failed instances by model and level."""
    k = F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("level"), (k % 4 > 0).alias("submitted"), ((k % 4 > 0) & (k % 7 == 0)).alias("resolved"), F.when(k % 4 == 0, "no_submission").when((k % 4 == 1) & (k % 5 == 0), "timeout").alias("error"))
    return reports.evaluation_summary(rows)


@query("""WITH c AS (SELECT c_mktsegment AS grp, c_nationkey % 5 = 0 AS file_match, c_nationkey % 3 = 0 AS type_match, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 100 / 100 END AS leak FROM customer)
SELECT grp, count(*) AS n, round(count(*) FILTER (file_match) / count(*), 6) AS file_match_rate, round(count(*) FILTER (type_match) / count(*), 6) AS type_match_rate, round(avg(leak), 6) AS mean_leak, count(*) FILTER (leak > 0.5) AS high, count(*) FILTER (leak = 0) AS no_leak FROM c GROUP BY 1""")
def leak_summary(spark, d):
    """How often a problem text gives its defect away."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("grp"), (F.col("c_nationkey") % 5 == 0).alias("file_match"), (F.col("c_nationkey") % 3 == 0).alias("type_match"), F.when(F.col("c_custkey") % 4 == 0, 0.0).otherwise(F.col("c_custkey") % 100 / 100).alias("leak"))
    return reports.leak_summary(c, ["grp"])


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT 'm' || l_suppkey || '.py') FILTER (l_linenumber <= 3) AS designed, list(DISTINCT 'm' || l_suppkey || '.py') FILTER (l_quantity > 15) AS traced, arg_min('m' || l_suppkey || '.py', (l_linenumber, l_suppkey)) AS root FROM lineitem GROUP BY 1),
x AS (SELECT *, len(list_intersect(coalesce(designed, []), coalesce(traced, []))) / greatest(len(coalesce(designed, [])), 1) AS overlap FROM g) SELECT count(*) AS n, count(*) FILTER (len(coalesce(traced, [])) > 0) AS has_trace, count(*) FILTER (list_contains(coalesce(traced, []), root)) AS root_hits, round(avg(overlap), 6) AS mean_overlap FROM x""")
def trace_summary(spark, d):
    """How much of designed chains traces run through; paths without the folder of the run."""
    f = F.concat(F.lit("/testbed/m"), "l_suppkey", F.lit(".py"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, f)).alias("designed"), F.collect_set(F.when(F.col("l_quantity") > 15, f)).alias("traced"), F.min_by(f, F.struct("l_linenumber", "l_suppkey")).alias("root"))
    return reports.trace_summary(g)


@query("SELECT o_orderpriority AS repo, count(DISTINCT o_custkey) AS seeds, count(*) AS bugs, round(count(*) / count(DISTINCT o_custkey), 6) AS per_seed, round(count(DISTINCT o_custkey) / (SELECT count(*) FROM customer), 6) AS rate FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def coverage_report(spark, d):
    """A4: distinct seeds, their share and defects for each."""
    bugs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("repo"), F.col("o_custkey").alias("seed"))
    return reports.coverage_report(bugs, table(spark, d, "customer").count(), ["repo"])


@query("SELECT side, p_partkey, rank FROM (SELECT 'head' AS side, p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part UNION ALL SELECT 'tail', p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) FROM part) WHERE rank <= 5")
def head_and_tail(spark, d):
    """The five most and least alike."""
    return reports.head_and_tail(table(spark, d, "part"), "p_retailprice", "p_partkey", 5).select("side", "p_partkey", "rank")


@query("""WITH n AS (SELECT o_orderpriority AS repo, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT repo, n, CASE WHEN n > 50 THEN greatest(ceil(n / least(4, greatest(2, n // 30)))::BIGINT, 1) ELSE n END AS size FROM n)
SELECT o_orderkey, o_orderpriority AS repo, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1) // size AS chunk FROM orders JOIN c ON repo = o_orderpriority""")
def repo_chunks(spark, d):
    """Instances of large repositories in chunks, in the order of their creation."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("repo"), "o_orderdate")
    return reports.chunks(o, "repo", ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", "repo", "chunk")


@query("SELECT conv_id, list(role ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def first_occurrences(spark, d):
    """Distinct values in the order in which they first occur."""
    first = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]).alias("roles"))


@query("SELECT l_orderkey, f AS found_files, round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_intersect(t, f)) / len(t) END, 6) AS file_recall FROM (SELECT l_orderkey, list_sort(coalesce(list(DISTINCT 'm' || l_suppkey) FILTER (l_linenumber % 2 = 0), [])) AS f, coalesce(list(DISTINCT 'm' || l_suppkey) FILTER (l_linenumber <= 2), []) AS t FROM lineitem GROUP BY 1)")
def localization_recall(spark, d):
    """Files of the true patch among those that were found."""
    f = F.concat(F.lit("m"), F.col("l_suppkey").cast("string"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, f))).alias("found_files"), F.collect_set(F.when(F.col("l_linenumber") <= 2, f)).alias("t"))
    recall = F.when(F.size("t") == 0, 0.0).otherwise(F.size(F.array_intersect("t", "found_files")) / F.size("t"))
    return g.select("l_orderkey", "found_files", F.round(recall, 6).alias("file_recall"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'done' ELSE 'pending' END AS state FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def pending_split(spark, d):
    """Instances of a list of targets, done or still pending."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return reports.split_done(o, done, "o_orderkey")


@query("SELECT event_id, hits, mode, tokens FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS hits, event_type AS mode, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS tokens FROM events)")
def usage_running(spark, d):
    """Running counts and totals of a usage log."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("hits"), F.col("event_type").alias("mode"), F.sum(F.floor("value")).over(w).cast("long").alias("tokens"))

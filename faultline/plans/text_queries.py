"""Queries on texts, patches, ids and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chains, names, patches
from ..functions import scalars as s
from ..operators import retrieval
from ..sources import exports, records
from .fixtures import table
from .registry import query

#: Fixtures as expressions that both engines read.
PATCH = """concat('--- a/src/m', p_partkey % 7, '/f', p_partkey % 5, '.py', chr(10), '+++ b/src/m', p_partkey % 7, '/f', p_partkey % 5, '.py', chr(10), '@@ -', p_partkey, ',', p_size, ' +', p_partkey + 1, ',3 @@ def run_', p_partkey % 11, '(x):', chr(10), ' same', chr(10), '-old ', p_size, chr(10), '+new ', p_brand,
  CASE WHEN p_partkey % 3 = 0 THEN concat(chr(10), '--- a/lib/g.py', chr(10), '+++ b/lib/g.py', chr(10), '@@ -9 +9 @@', chr(10), '-a', chr(10), '+b', chr(10), '+c', chr(10), '@@ -20,2 +21,2 @@ class Big', chr(10), '-z') ELSE '' END)"""
INSTANCE = "CASE s_suppkey % 7 WHEN 0 THEN concat('Own', s_nationkey, '__repo-', s_suppkey % 5, '-x-', s_suppkey) WHEN 1 THEN concat('bare', s_suppkey, '-', s_nationkey) WHEN 2 THEN concat('A-b__C_d', s_nationkey, '-', s_suppkey) WHEN 3 THEN concat('o', s_nationkey, '__plain', s_suppkey) WHEN 4 THEN concat('x__y', s_nationkey, '__z-', s_suppkey) ELSE concat(lower(s_name), '__', s_name, '-', s_suppkey) END"
PATH = "CASE s_suppkey % 11 WHEN 0 THEN concat('src/pkg', s_nationkey, '/utils.py') WHEN 1 THEN concat('lib/mod', s_suppkey, '.py') WHEN 2 THEN 'src/tests/__init__.py' WHEN 3 THEN concat('django/db', s_nationkey, '/models.py') WHEN 4 THEN concat('a/b', s_suppkey, '/c/views.py') WHEN 5 THEN 'base.py' WHEN 6 THEN concat('deep/', s_name, '/lib/tests.py') WHEN 7 THEN concat('m', s_nationkey, '.py') WHEN 8 THEN concat('x/y_', s_suppkey, '/z_', s_nationkey, '.py') WHEN 9 THEN concat('src/', s_nationkey, '/lib/base.py') ELSE concat('top', s_suppkey, '/__init__.py') END"
NODE = "CASE s_suppkey % 6 WHEN 0 THEN concat('a/b', s_nationkey, '.py:Thing', s_suppkey, '.run') WHEN 1 THEN concat('a/b.py:func_', s_suppkey) WHEN 2 THEN concat('a/only', s_suppkey, '.py') WHEN 3 THEN concat('x:y', s_nationkey, ':Zed.q', s_suppkey) WHEN 4 THEN concat('m.py:lower.go', s_suppkey) ELSE concat('m.py:A.B.c', s_suppkey) END"
_SPLIT = r"regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1))"
_GIVES = " OR ".join(f"regexp_matches(x, '{p}')" for p in names.GIVEAWAYS)
_HUNKS = rf"""parts AS (SELECT p_partkey, unnest(string_split(replace({PATCH}, chr(10) || '--- a/', chr(1) || '--- a/'), chr(1))) AS part FROM part),
heads AS (SELECT p_partkey, regexp_extract(part, '(?m)^\+\+\+ b/(.+)$', 1) AS file, unnest(regexp_extract_all(part, '(?m)^(@@ .*)$', 1)) AS head FROM parts),
hunks AS (SELECT p_partkey, file, regexp_extract(head, '{patches.HUNK}', 1)::BIGINT AS old_start, coalesce(nullif(regexp_extract(head, '{patches.HUNK}', 2), ''), '1')::BIGINT AS old_count, regexp_extract(head, '{patches.HUNK}', 3)::BIGINT AS new_start, coalesce(nullif(regexp_extract(head, '{patches.HUNK}', 4), ''), '1')::BIGINT AS new_count, nullif(regexp_extract(head, '(?:def|class) (\w+)', 1), '') AS entity FROM heads)"""


def _patches(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(PATCH).alias("patch"))


@query(f"WITH {_HUNKS} SELECT * FROM hunks")
def patch_hunks(spark, d):
    """Hunks with their file, ranges and entity."""
    return patches.hunks(_patches(spark, d), "p_partkey", "patch")


@query(f"WITH {_HUNKS} SELECT p_partkey, file, list_sort(CASE WHEN count(entity) > 0 THEN list(DISTINCT file || ':' || entity) FILTER (entity IS NOT NULL) ELSE [file] END) AS modules FROM hunks GROUP BY p_partkey, file")
def patch_modules(spark, d):
    """the entities of each changed file, or the file."""
    return patches.modules(patches.hunks(_patches(spark, d), "p_partkey", "patch"), "p_partkey")


@query(f"""SELECT p_partkey, list_distinct(regexp_extract_all(p, '(?m)^\\+\\+\\+ b/(.+)$', 1)) AS files0, len(list_filter(string_split(p, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS added,
len(list_filter(string_split(p, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS removed FROM (SELECT p_partkey, {PATCH} AS p FROM part)""".replace("list_distinct(", "list_sort(list_distinct(").replace("1)) AS files0", "1))) AS files"))
def patch_counts(spark, d):
    """Files and changed lines of a patch."""
    added, removed = s.changed_lines(F.col("patch"))
    return _patches(spark, d).select("p_partkey", F.array_sort(s.patch_files(F.col("patch"))).alias("files"), F.size(added).cast("long").alias("added"), F.size(removed).cast("long").alias("removed"))


@query(f"SELECT item_id, len({_SPLIT}) AS n_sentences, len(list_filter({_SPLIT}, lambda x: {_GIVES})) AS n_giveaways FROM benchmark")
def sentence_giveaways(spark, d):
    """Sentences, and those that give a repair away."""
    sentences = s.sentences(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.size(sentences).cast("long").alias("n_sentences"), F.size(F.filter(sentences, names.gives_away)).cast("long").alias("n_giveaways"))


@query(f"SELECT s_suppkey, CASE WHEN contains(i, '__') THEN string_split(i, '__')[1] || '/' || regexp_replace(string_split(i, '__')[2], '-[^-]*$', '') ELSE i END AS repo, 'img.' || lower(replace(i, '__', '_1776_')) AS image FROM (SELECT s_suppkey, {INSTANCE} AS i FROM supplier)")
def instance_names(spark, d):
    """repository and image of an instance id."""
    i = F.expr(INSTANCE)
    return table(spark, d, "supplier").select("s_suppkey", names.repo_of(i).alias("repo"), names.image_of("img.", i).alias("image"))


_STEM = "regexp_extract(f, '([^/]*)\\.py$', 1)"


@query(f"WITH p AS (SELECT s_suppkey, {PATH} AS f, {NODE} AS node FROM supplier) SELECT s_suppkey, CASE WHEN {_STEM} IN {names.DULL_STEMS} THEN coalesce(list_filter(string_split(f, '/')[:-2], lambda x: x NOT IN ('', 'src', 'lib', 'django', 'tests', '__pycache__'))[-1], {_STEM}) ELSE {_STEM} END AS module, CASE WHEN contains(node, ':') THEN string_split(string_split(node, ':')[-1], '.')[-1] ELSE '' END AS func, CASE WHEN contains(node, ':') AND regexp_matches(string_split(node, ':')[-1], '^[A-Z][^.]*[.]') THEN string_split(string_split(node, ':')[-1], '.')[1] ELSE '' END AS cls, node FROM p")
def node_names(spark, d):
    """Module of a path, function and class of a node id."""
    node = F.expr(NODE)
    return table(spark, d, "supplier").select("s_suppkey", names.module_of(F.expr(PATH)).alias("module"), names.node_function(node).alias("func"), names.node_class(node).alias("cls"), node.alias("node"))


@query(f"WITH p AS (SELECT s_suppkey, {NODE} AS n FROM supplier) SELECT s_suppkey, CASE WHEN contains(n, ':') THEN CASE WHEN string_split(n, ':')[1] LIKE '%.py' OR contains(string_split(n, ':')[1], '/') THEN string_split(n, ':')[1] ELSE '' END ELSE n END AS file, CASE WHEN contains(n, ':') THEN string_split(n, ':')[-1] ELSE '' END AS func FROM p")
def node_hints(spark, d):
    """the file and the function that a node id hints at."""
    h = chains.hints(F.expr(NODE))
    return table(spark, d, "supplier").select("s_suppkey", h["file"].alias("file"), h["func"].alias("func"))


_FILE = "concat('src/n', c_nationkey, '/', lower(c_mktsegment), '.py')"
_GUESSED = "CASE c_custkey % 9 WHEN 0 THEN concat('/', {f}, '/') WHEN 1 THEN concat(lower(c_mktsegment), '.py ') WHEN 2 THEN concat('other/n', c_nationkey, '/', lower(c_mktsegment), '.py') WHEN 3 THEN concat('src/n', c_nationkey, '/', lower(c_mktsegment), '2.py') WHEN 4 THEN concat('CANNOT_DETERMINE ', {f}) WHEN 5 THEN '' WHEN 6 THEN concat(' ', {f}) WHEN 7 THEN c_name ELSE {f} END".format(f=_FILE)


@query(f"""WITH g AS (SELECT c_custkey, {_GUESSED} AS g, {_FILE} AS f, c_nationkey < 9 AS kind, c_custkey % 10 / 10 AS conf FROM customer), m AS (SELECT *, g <> '' AND NOT contains(lower(g), 'cannot_determine') AND string_split(regexp_replace(trim(g), '^/+|/+$', '', 'g'), '/')[-1] = string_split(f, '/')[-1] AS same FROM g)
SELECT c_custkey, same AS file_match, round(least(1, CASE WHEN same THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN kind THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN conf > 0.7::DOUBLE THEN 0.3::DOUBLE WHEN conf > 0.4::DOUBLE THEN 0.15::DOUBLE ELSE 0 END), 4) AS leak FROM m""")
def leak_scores(spark, d):
    """file match and leak score of a guess."""
    match = names.same_file(F.expr(_GUESSED), F.expr(_FILE))
    return table(spark, d, "customer").select("c_custkey", match.alias("file_match"), F.round(names.leak_score(match, F.col("c_nationkey") < 9, F.col("c_custkey") % 10 / 10), 4).alias("leak"))


#: The common signs of a crash and two of a repository, with quotes doubled as in SQL.
_EXTRA = (("django.core.exceptions.ImproperlyConfigured", "setup_error"), ("conftest failed", "conftest_error"))
_SIGNS = tuple((sign.replace("'", "''"), kind) for sign, kind in (*names.CRASHES, *_EXTRA))
_LOG = lambda key: "concat('run ', event_id, chr(10), CASE " + key + " " + " ".join(f"WHEN {i} THEN concat('{sign} ', event_type)" for i, (sign, _) in enumerate(_SIGNS)) + " ELSE 'all fine' END, chr(10), CASE WHEN event_id % 4 = 0 THEN 'NameError: late' ELSE event_type END)"
_ANY = " OR ".join(f"contains(a, '{sign}')" for sign, _ in _SIGNS)
_FIRST = " ".join(f"WHEN contains(b, '{sign}') THEN '{kind}'" for sign, kind in _SIGNS)


@query(f"WITH l AS (SELECT event_id, {_LOG('user_id % 23')} AS a, {_LOG('CAST(floor(value) AS BIGINT) % 14')} AS b FROM events) SELECT event_id, CASE WHEN {_ANY} THEN NULL {_FIRST} END AS crash FROM l")
def crash_kinds(spark, d):
    """Crashes that only the second log shows, with further signs of a repository."""
    return table(spark, d, "events").select("event_id", names.crash(F.expr(_LOG("user_id % 23")), F.expr(_LOG("CAST(floor(value) AS BIGINT) % 14")), _EXTRA).alias("crash"))


_FIELDS = {f: f"CASE WHEN (o_orderkey + {i}) % {i + 5} = 0 THEN NULL ELSE concat('{f}', o_custkey) END" for i, f in enumerate(exports.REQUIRED[1:])}


@query("SELECT o_orderkey AS instance_id, missing_fields FROM (SELECT o_orderkey, list_filter([" + ", ".join(f"CASE WHEN ({e}) IS NULL THEN '{f}' END" for f, e in _FIELDS.items()) + "], lambda x: x IS NOT NULL) AS missing_fields FROM orders) WHERE len(missing_fields) > 0")
def missing_fields(spark, d):
    """P10: the required fields that an instance lacks."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("instance_id"), *[F.expr(e).alias(f) for f, e in _FIELDS.items()])
    return exports.invalid_rows(rows)


@query("SELECT o_orderkey AS instance_id, o_orderpriority AS repo, 'c' || o_custkey AS base_commit, o_orderstatus AS patch FROM orders WHERE o_custkey % 3 = 0")
def standard_rows(spark, d):
    """Synthetic instances in the standard form."""
    given = {"repo": F.col("o_orderpriority"), "base_commit": F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "patch": F.col("o_orderstatus")}
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("instance_id"), *[given.get(c, F.lit("x")).alias(c) for c in exports.STANDARD[1:]], (F.col("o_custkey") % 3 == 0).alias("synthetic"))
    return exports.standard(rows).select("instance_id", "repo", "base_commit", "patch")


@query("""SELECT o_orderkey AS instance_id, '["' || o_orderstatus || '","t' || o_custkey || '"]' AS fail_to_pass, o_custkey % 6 AS chain_depth, greatest(o_custkey % 6 - 1, 0) AS chain_length FROM orders""")
def exported_rows(spark, d):
    """Synthetic defects in the standard form, their tests as JSON and their chains measured."""
    o = table(spark, d, "orders")
    chain = F.slice(F.array(*[F.concat(F.lit(f"n{i}_"), F.col("o_custkey").cast("string")) for i in range(6)]), F.lit(1), (F.col("o_custkey") % 6).cast("int"))
    tests = F.array("o_orderstatus", F.concat(F.lit("t"), F.col("o_custkey").cast("string")))
    rows = o.select(F.col("o_orderkey").alias("instance_id"), *[F.lit("x").alias(c) for c in ("repo", "base_commit", "problem_statement", "patch", "test_patch", "seed_id", "fix_intent")], tests.alias("fail"), tests.alias("keep"), chain.alias("chain"))
    return exports.exported(rows).select("instance_id", F.col("FAIL_TO_PASS").alias("fail_to_pass"), *[F.get_json_object("metadata", f"$.{c}").cast("long").alias(c) for c in ("chain_depth", "chain_length")])


@query(f"""SELECT s_suppkey, 'img.' || lower(replace(i, '__', '_1776_')) || ':latest' AS image_name, concat('printf %s ', chr(39), 'it', chr(39), chr(34), chr(39), chr(34), chr(39), 's ', s_name, chr(39), ' | git apply -') AS setup FROM (SELECT *, {INSTANCE} AS i FROM supplier)""")
def tool_instances(spark, d):
    """Instances for an agent tool, with image and quoted patch."""
    rows = table(spark, d, "supplier").select("s_suppkey", F.expr(INSTANCE).alias("instance_id"), F.lit("p").alias("problem_statement"), F.concat(F.lit("it's "), "s_name").alias("patch"))
    keyed = exports.tool_instances(rows, "img.").join(rows.select("s_suppkey", "instance_id"), "instance_id")
    return keyed.select("s_suppkey", "image_name", "setup")


@query("""WITH a AS (SELECT c_custkey, 'r' || c_nationkey AS repo, md5(c_name) AS commit FROM customer), p AS (SELECT 'p' || c_custkey AS pool, 'r' || c_nationkey AS repo, CASE c_custkey % 3 WHEN 0 THEN substr(md5(c_name), 1, 8) WHEN 1 THEN md5(c_name) ELSE 'zz' || c_custkey END AS commit, 1 + c_custkey % 2 AS version, c_custkey AS t FROM customer WHERE c_custkey % 4 < 2)
SELECT c_custkey, arg_min(pool, (-version, CASE WHEN p.commit = substr(a.commit, 1, 8) THEN 0 WHEN p.commit = a.commit THEN 1 ELSE 2 END, CASE WHEN p.commit NOT IN (substr(a.commit, 1, 8), a.commit) THEN -t ELSE 0 END, pool)) AS pool FROM a LEFT JOIN p USING (repo) GROUP BY 1""")
def chosen_pools(spark, d):
    """The pool of vectors that serves a commit: its own, else the newest of its repository, new forms first."""
    c = table(spark, d, "customer")
    repo, commit = F.concat(F.lit("r"), F.col("c_nationkey").cast("string")), F.md5("c_name")
    kept = F.when(F.col("c_custkey") % 3 == 0, F.substring(commit, 1, 8)).when(F.col("c_custkey") % 3 == 1, commit).otherwise(F.concat(F.lit("zz"), F.col("c_custkey").cast("string")))
    pools = c.where("c_custkey % 4 < 2").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("pool"), repo.alias("repo"), kept.alias("commit"), (1 + F.col("c_custkey") % 2).cast("int").alias("version"), F.timestamp_seconds("c_custkey").alias("mtime"))
    asked = c.select("c_custkey", repo.alias("repo"), commit.alias("commit"))
    return asked.join(exports.chosen_pools(asked.select("repo", "commit"), pools), ["repo", "commit"]).select("c_custkey", "pool")


@query("SELECT vec_id, min(h) AS hash, round(sqrt(list_dot_product(any_value(e), any_value(e))), 5) AS norm FROM (SELECT vec_id, md5(label || ':' || vec_id % 40) AS h, first_value(embedding::DOUBLE[]) OVER (PARTITION BY label, vec_id % 40 ORDER BY vec_id) AS e FROM embeddings) GROUP BY vec_id")
def pool_vectors(spark, d):
    """Nodes with the vector of their content's hash, one a hash, and its norm."""
    v = table(spark, d, "embeddings").select("vec_id", F.md5(F.concat(F.col("label").cast("string"), F.lit(":"), (F.col("vec_id") % 40).cast("string"))).alias("hash"), "embedding")
    pool = v.groupBy("hash").agg(F.min_by("embedding", "vec_id").alias("vector"))
    keys = v.select(F.col("vec_id").alias("node_id"), "hash")
    return retrieval.with_norms(records.pool_vectors(keys, pool).join(keys, "node_id"), "vector").select(F.col("node_id").alias("vec_id"), "hash", F.round("norm", 5).alias("norm"))


_KINDS = ("Condition_Refinement", "Argument-Update", "statement insertion", "Constant_Update", "Type_Cast_Fix", "Guard_Clause_Addition", "Var_Replace", "Return_Value", "Else")
_GUESS = ("a new if statement", "wrong parameter", "insert it", "the literal 3", "CANNOT_DETERMINE cast", "early return", "rename x", "output", "Argument Update", "else", "", "Condition refinement of x")
_PICK = lambda values, key: "CASE " + key + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
_MEANT = " OR ".join(f"(contains(a, '{k}') AND ({' OR '.join(f"contains(g, '{w}')" for w in ws)}))" for k, ws in names.KIND_WORDS.items())


@query(f"WITH c AS (SELECT c_custkey, {_PICK(_GUESS, 'c_custkey % 12')} AS guess, lower(replace(replace({_PICK(_GUESS, 'c_custkey % 12')}, '_', ' '), '-', ' ')) AS g, lower(replace(replace({_PICK(_KINDS, 'c_nationkey % 9')}, '_', ' '), '-', ' ')) AS a FROM customer) SELECT c_custkey, guess <> '' AND NOT contains(lower(guess), 'cannot_determine') AND (contains(g, a) OR contains(a, g) OR {_MEANT}) AS same FROM c")
def same_kinds(spark, d):
    """does a guess mean the kind of repair?"""
    guess, actual = F.expr(_PICK(_GUESS, "c_custkey % 12")), F.expr(_PICK(_KINDS, "c_nationkey % 9"))
    return table(spark, d, "customer").select("c_custkey", names.same_kind(guess, actual).alias("same"))

"""Queries on profiles of repositories: where tests of sources lie, labels both ways, and the commands that run the tests of a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commands, labels, profiles
from .fixtures import table
from .registry import query

_NAMES = list(profiles.FRAMEWORKS)
_PROFILE = "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_NAMES)) + " END"
_PATH = """CASE p_partkey % 14 WHEN 0 THEN 'django/utils/text.py' WHEN 1 THEN concat('django/db/m', p_size, '.py') WHEN 2 THEN concat('src/_pytest/mark/x', p_size, '.py') WHEN 3 THEN concat('src/_pytest/__n', p_size, '.py')
  WHEN 4 THEN concat('lib/matplotlib/_a', p_size, '.py') WHEN 5 THEN concat('lib/mpl_toolkits/axes/b', p_size, '.py') WHEN 6 THEN concat('sphinx/builders/latex/c', p_size, '.py') WHEN 7 THEN concat('sphinx/ext/auto', p_size, '/__init__.py')
  WHEN 8 THEN concat('pylint/checkers/v', p_size, '.py') WHEN 9 THEN concat('pylint/pyreverse/w', p_size, '.py') WHEN 10 THEN concat('xarray/core/d', p_size, '.v.py') WHEN 11 THEN concat('tests/e', p_size, '/test_x.py')
  WHEN 12 THEN concat('sympy/core/tests/test_f', p_size, '.py') ELSE concat('setup', p_size, '.py') END"""
_STATED = "stated AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {i}, '{part}', {tests})" for p, rules in profiles.TESTS_OF_PATHS.items() for i, (part, tests) in enumerate(rules.items())) + ") t(profile, ord, part, tests))"
_USUAL = """CASE
  WHEN profile IN ('sympy/sympy', 'scikit-learn/scikit-learn', 'astropy/astropy') THEN CASE WHEN contains(path, '/tests/') THEN [path] ELSE [folder || '/tests/test_' || stem || '.py'] END
  WHEN profile = 'matplotlib/matplotlib' THEN CASE WHEN contains(path, '/tests/') THEN [path] WHEN starts_with(path, 'lib/mpl_toolkits/') THEN [folder || '/tests/test_' || stem || '.py'] ELSE ['lib/matplotlib/tests/test_' || stem || '.py'] END
  WHEN profile = 'pydata/xarray' THEN CASE WHEN contains(path, '/tests/') THEN [path] ELSE ['xarray/tests/test_' || stem || '.py'] END
  WHEN profile = 'pytest-dev/pytest' THEN ['testing/test_' || stem || '.py', 'testing/python/test_' || stem || '.py', 'testing/python/' || stem || '.py']
  WHEN profile = 'psf/requests' THEN CASE WHEN starts_with(path, 'tests/') OR starts_with(path, 'test_') THEN [path] ELSE ['test_' || stem || '.py', 'tests/test_' || stem || '.py', 'test_requests.py', 'tests/test_requests.py'] END
  WHEN profile = 'sphinx-doc/sphinx' THEN CASE WHEN starts_with(path, 'tests/') THEN [path]
    WHEN contains(path, 'builders') OR starts_with(path, 'sphinx/') THEN CASE WHEN contains(path, 'builders') THEN ['tests/test_build_' || stem || '.py'] ELSE [] END || CASE WHEN starts_with(path, 'sphinx/') THEN list_transform(range(len(steps), 0, -1), lambda i: 'tests/test_' || array_to_string(steps[1:i], '_') || '.py') ELSE [] END
    ELSE ['tests/test_' || stem || '.py'] END
  WHEN profile = 'pylint-dev/pylint' THEN CASE WHEN starts_with(path, 'tests/') THEN [path] WHEN starts_with(path, 'pylint/checkers/') THEN ['tests/checkers/unittest_' || stem || '.py', 'tests/checkers/test_' || stem || '.py']
    WHEN starts_with(path, 'pylint/pyreverse/') THEN ['tests/unittest_pyreverse_' || stem || '.py', 'tests/pyreverse/test_' || stem || '.py', 'tests/pyreverse/unittest_' || stem || '.py'] WHEN starts_with(path, 'pylint/reporters/') THEN ['tests/reporters/unittest_reporting.py', 'tests/reporters/unittest_' || stem || '.py'] ELSE ['tests/unittest_' || stem || '.py', 'tests/test_' || stem || '.py'] END
  ELSE [folder || '/tests/test_' || stem || '.py', folder || '/test_' || stem || '.py', 'tests/test_' || stem || '.py'] || CASE WHEN profile = 'generic' THEN ['test_' || stem || '.py'] ELSE [] END END"""
_PARTS = r"""SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder, ltrim(regexp_replace(regexp_extract(path, '[^/]*$'), '\.py$', ''), '_') AS stem,
    list_filter(string_split(regexp_replace(regexp_replace(path, '\.py$', ''), '^sphinx/', ''), '/'), lambda x: x <> '__init__') AS steps"""


@query(f"""WITH {_STATED}, p AS (SELECT p_partkey, {_PROFILE} AS profile, {_PATH} AS path FROM part), q AS ({_PARTS} FROM p), u AS (SELECT *, {_USUAL} AS usual FROM q),
first AS (SELECT p_partkey, arg_min(tests, ord) AS tests FROM q JOIN stated USING (profile) WHERE contains(path, part) GROUP BY 1)
SELECT p_partkey, profile, path, usual, coalesce(tests, usual[1:1]) AS tests FROM u LEFT JOIN first USING (p_partkey)""")
def tests_by_convention(spark, d):
    """where ten profiles and the generic one look for the tests of a source file."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_PROFILE).alias("profile"), F.expr(_PATH).alias("path"))
    p, s = F.col("profile"), F.col("path")
    return rows.withColumns({"usual": profiles.usual_tests(p, s), "tests": profiles.tests_of(p, s)})


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'unittest' WHEN p_partkey % 11 = 1 THEN 'sympy_bin_test' ELSE 'pytest' END AS framework, CASE p_partkey % 11 {' '.join(f"WHEN {i} THEN '{profiles.FRAMEWORKS[p][1]}'" for i, p in enumerate(_NAMES))} END AS test_root,
  CASE WHEN p_partkey % 11 = 0 THEN './tests/runtests.py {{}} --verbosity=2' WHEN p_partkey % 11 = 1 THEN 'PYTHONWARNINGS=''ignore::UserWarning,ignore::SyntaxWarning'' bin/test -C --verbose {{}}' ELSE 'pytest {{}} -v --tb=short' END AS template,
  CASE WHEN p_partkey % 11 = 0 THEN ['gis_tests'] ELSE [] END AS disallowed, CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE 0 END AS signs FROM part""")
def profile_settings(spark, d):
    """What the profile of a repository says of its tests; names differ in case or hold the profile's."""
    repo = F.expr(f"CASE WHEN p_partkey % 11 = 10 THEN concat('own/', p_brand) WHEN p_size % 2 = 0 THEN upper({_PROFILE}) ELSE concat('mirror/', {_PROFILE}) END")
    rows = table(spark, d, "part").select("p_partkey", labels.profile_of(repo).alias("profile")).select("p_partkey", profiles.settings(F.col("profile")).alias("s"))
    return rows.select("p_partkey", "s.framework", "s.test_root", "s.template", "s.disallowed", F.size("s.crash_signs").alias("signs"))


_LABEL = "CASE c_custkey % 4 WHEN 0 THEN concat('m', c_nationkey, '.tests.Case.test_', c_custkey) WHEN 1 THEN concat('a', c_nationkey, '.test_', c_custkey) WHEN 2 THEN concat('b', c_nationkey, '.sub.test_', c_custkey) ELSE concat('c', c_nationkey, '.forms.Case') END"


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'tests/m' || c_nationkey || '/tests.py::Case::test_' || c_custkey WHEN 1 THEN 'tests/a' || c_nationkey || '/test_' || c_custkey || '.py' WHEN 2 THEN 'tests/b' || c_nationkey || '/sub.py::test_' || c_custkey ELSE 'tests/c' || c_nationkey || '/forms.py::Case' END AS test_id, TRUE AS there_and_back FROM customer")
def ids_of_labels(spark, d):
    """dotted labels as test ids below a folder, and back."""
    label = F.expr(_LABEL)
    test = profiles.path_of_label(label, F.lit("tests"))
    return table(spark, d, "customer").select("c_custkey", test.alias("test_id"), (labels.to_dotted(test) == label).alias("there_and_back"))


# A change for each order. What its lists hold depends on its price, so that kinds, modes and lists meet in all ways.
_V = "CAST(floor(o_totalprice) AS BIGINT)"
_CHANGE = {
    "repo": "CASE o_custkey % 6 WHEN 0 THEN 'django/django' WHEN 1 THEN 'sympy/sympy' WHEN 2 THEN 'psf/requests' WHEN 3 THEN concat('own/r', o_custkey % 9) WHEN 4 THEN CAST(NULL AS {t}) ELSE '' END",
    "seed": "CASE WHEN o_custkey % 6 = 4 THEN CASE o_orderkey % 3 WHEN 0 THEN 'django__django-14787' WHEN 1 THEN 'Django__x-11099' ELSE 'django__django-1' END ELSE 'other-1' END",
    "mode": f"CASE {_V} % 4 WHEN 0 THEN 'min' WHEN 1 THEN 'Fast ' WHEN 2 THEN CAST(NULL AS {{t}}) ELSE 'suite' END",
    "own_command": f"CASE WHEN {_V} % 41 = 0 THEN concat('make check', o_orderkey % 3) END",
    "planned_command": f"CASE {_V} % 9 WHEN 0 THEN ' ./tests/runtests.py a ' WHEN 1 THEN concat('python -m pytest tests/auth', o_orderkey % 9, '/test_a.py::X::y tests/gis_tests/b.py -q') WHEN 2 THEN 'bin/test x.py' WHEN 3 THEN concat('pytest lib/t', o_orderkey % 5, '.py y.py') WHEN 4 THEN 'tox' END",
}
_LISTS = {
    "planned_modules": (f"{_V} % 7", {0: ["tests/mail/tests.py", "gis_tests.x", "x y", "cache", ""], 1: ["gis_tests"], 2: [f"m{i}" for i in range(8)]}),
    "fail": (f"{_V} % 11", {0: ["tests/dec/tests.py::CaseA::test_a", "tests/dec/tests.py::CaseA::test_b"], 1: ["cache.tests.BaseCacheTests.test_x"], 2: ["test_bug", " "], 3: ["./tests/utils/test_text.py", "forms_tests.tests.FormTest.test_y", "mail"], 4: ["test_add"], 5: ["gis_tests.tests.G.test_z"], 6: ["a.b.C.test_1", "a.b.C.test_2", "a.c.D.test_3"]}),
    "keep": (f"{_V} % 5", {0: ["auth_tests.test_models.UserTest.test_u", "auth_tests.test_views.ViewTest.test_v"], 1: ["sympy/core/tests/test_add.py::test_w", "tests/dec/tests.py::CaseA::test_a"], 2: ["x.y.BaseZTest.test_q"], 3: [" "]}),
}
_PATCH = {0: "django/utils/text.py", 1: "sympy/core/_add.py", 2: "requests/models.py", 3: "lib/x.py", 4: "tests/test_old.py"}


def _lists(sql: bool) -> dict[str, str]:
    literal = lambda xs: ("[" if sql else "array(") + ", ".join(f"'{x}'" for x in xs) + ("]" if sql else ")")
    out = {c: f"CASE {by} " + " ".join(f"WHEN {k} THEN {literal(v)}" for k, v in lists.items()) + " END" for c, (by, lists) in _LISTS.items()}
    paths = " ".join(f"WHEN {k} THEN '{v}'" for k, v in _PATCH.items())
    out["patch"] = f"CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('--- a/', CASE o_orderkey % 5 {paths} END, chr(10), '+++ b/', CASE o_orderkey % 7 {paths} ELSE 'django/db/models/q.py' END, chr(10), '@@ -1 +1 @@') END"
    out["target"] = f"CASE o_orderkey % 4 WHEN 0 THEN 'sympy/core/mul.py:f' WHEN 1 THEN 'django/http/a.py:g' WHEN 2 THEN 'no_file' END"
    return {c: e.format(t="VARCHAR" if sql else "STRING") for c, e in _CHANGE.items()} | out


def _uniq(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def _tests(files: str) -> str:
    """Tests of files by the kind of the row: as_usual holds what the three profiles here have."""
    usual = "CASE WHEN contains(f, '/tests/') AND profile = 'sympy/sympy' THEN f WHEN profile = 'psf/requests' AND (starts_with(f, 'tests/') OR starts_with(f, 'test_')) THEN f WHEN profile = 'psf/requests' THEN 'test_' || stem(f) || '.py' ELSE folder(f) || '/tests/test_' || stem(f) || '.py' END"
    legacy = "CASE WHEN kind = 'unnamed_django' THEN CASE WHEN stated('django/django', f) IS NULL THEN [] ELSE stated('django/django', f) END WHEN contains(f, 'test') THEN [f] ELSE ['tests/test_' || replace(regexp_extract(f, '[^/]*$'), '.py', '') || '.py'] END"
    return f"flatten(list_transform({files}, lambda f: CASE WHEN profile IS NULL THEN {legacy} ELSE coalesce(stated(profile, f), [{usual}]) END))"


def _stated_case(p: str, f: str) -> str:
    """stated(p, f) written out: DuckDB has no functions inside a query."""
    rules = " ".join(f"WHEN {p} = '{name}' AND contains({f}, '{part}') THEN {tests}" for name, rs in profiles.TESTS_OF_PATHS.items() for part, tests in rs.items())
    return f"CASE {rules} END"


def _written_out(sql: str) -> str:
    name = "ltrim(regexp_replace(regexp_extract(f, '[^/]*$'), '\\.py$', ''), '_')"
    folder = "CASE WHEN contains(f, '/') THEN regexp_replace(f, '/[^/]*$', '') ELSE '.' END"
    for call, case in (("stated('django/django', f)", _stated_case("'django/django'", "f")), ("stated(profile, f)", _stated_case("profile", "f")), ("stem(f)", name), ("folder(f)", folder)):
        sql = sql.replace(call, case)
    return sql


def _command_sql() -> str:
    fixture = ", ".join(f"{e} AS {c}" for c, e in _lists(True).items())
    dotted = r"CASE WHEN contains(t, '::') THEN replace(regexp_replace(replace(replace(t, '::', '.'), '/', '.'), '^tests\.', ''), '.py.', '.') WHEN contains(t, '/') AND ends_with(t, '.py') THEN replace(regexp_replace(regexp_replace(t, '^(\./)?tests/', ''), '\.py$', ''), '/', '.') ELSE t END"
    is_label = r"NOT regexp_matches(t, '[ \t\n/]') AND contains(t, '.') AND NOT regexp_matches(t, '^(Traceback|ERROR|FAIL)')"
    holders = "('test_reproduce_bug', 'test_synthetic', 'test_bug', 'test_method', 'test_view')"
    collapse = r"regexp_replace(regexp_replace(x, '^([^.]+\.[^.]+(\.[^.]+)*)\.test[^.]*$', '\1'), '^([^.]+\.[^.]+(\.[^.]+)*)\.[A-Z][^.]*$', '\1')"
    bad = r"regexp_matches(t, '(^|\.)Base[^.]*Test')"
    allowed = "NOT (x = 'gis_tests' OR starts_with(x, 'gis_tests.'))"
    top = lambda e: f"string_split({e}, '.')[1]"
    path_top = top(r"regexp_replace(replace(replace(x, '/', '.'), '.py', ''), '^tests\.', '')")
    dj = lambda e: f"'./tests/runtests.py ' || array_to_string({e}, ' ') || ' --verbosity=2'"
    py = lambda e, tail=" --tb=short": f"'pytest ' || array_to_string({e}, ' ') || ' -v{tail}'"
    sy = lambda e: f"'PYTHONWARNINGS=''ignore::UserWarning,ignore::SyntaxWarning'' bin/test -C --verbose ' || array_to_string({e}, ' ')"
    last = "'./tests/runtests.py decorators utils_tests --verbosity=2'"
    short = lambda e: "list_filter(" + _uniq(f"list_transform({e}, lambda x: {top('x')})") + f", lambda x: {allowed})[1:6]"
    some = lambda ladder: " ".join(f"WHEN {cond} THEN {{{{'strategy': '{name}', 'command': {cmd}}}}}" for name, cond, cmd in ladder)
    words = r"list_filter(string_split_regex(planned, '\s+'), lambda w: w <> '' AND NOT starts_with(w, '-') AND w NOT IN ('pytest', 'python', '-m'))"
    conv = "list_filter(" + _uniq(f"list_transform(list_filter(list_transform({words}, lambda w: string_split(w, '::')[1]), lambda x: contains(x, '/') OR ends_with(x, '.py')), lambda x: {path_top})") + f", lambda x: x <> '' AND {allowed})[1:6]"
    mods = _uniq(f"list_filter(list_transform(modules, lambda x: CASE WHEN contains(x, '/') OR ends_with(x, '.py') THEN {path_top} ELSE x END), lambda x: NOT contains(x, ' ') AND {allowed})") + "[1:6]"
    own_label = r"CASE WHEN NOT contains(trim(t), '::') AND contains(t, '.') AND NOT contains(t, '/') THEN trim(t) ELSE trim(replace(regexp_replace(replace(replace(trim(t), '::', '.'), '/', '.'), '^tests\.', ''), '.py.', '.'), '.') END"
    tops = f"list_transform(list_filter(list_transform(fail || CASE WHEN mode = 'module_suite' THEN keep ELSE [] END, lambda t: {own_label}), lambda t: {is_label}), lambda x: {top('x')})"
    every = "list_transform(fail || keep, lambda t: trim(t))"
    bare = "NOT contains(t, '::') AND NOT contains(t, '/') AND NOT ends_with(t, '.py')"
    sym = _uniq(f"(list_transform(list_filter({every}, lambda t: NOT ({bare})), lambda t: string_split(t, '::')[1]) || CASE WHEN len(list_filter({every}, lambda t: {bare})) > 0 THEN of_target ELSE [] END)") + "[1:6]"
    pyw = r"list_filter(string_split_regex(planned, '\s+'), lambda w: ends_with(w, '.py') AND contains(w, '/'))"
    files = _uniq("list_transform(fail || keep, lambda t: string_split(t, '::')[1])") + "[1:6]"
    fast = lambda f, k, fill: (_uniq(f"({f}[1:1] || {k}[1:1]" + (f" || {f})" if fill else ")")) + "[1:6]")
    merged = f"list_sort(list_distinct(list_transform(CASE WHEN mode = 'fast' AND len(fl) > 0 AND len(kl) > 0 THEN [] ELSE fl END, lambda x: {collapse}) || list_transform(kl, lambda x: {collapse}) || CASE WHEN len(paths) > 0 THEN of_paths ELSE of_target END))"
    only_dotted = "CASE WHEN len(list_filter(m0, lambda x: contains(x, '.'))) > 0 THEN list_filter(m0, lambda x: contains(x, '.')) ELSE m0 END"
    pruned = "list_filter(m1, lambda x: len(list_filter(m1, lambda y: starts_with(y, x || '.'))) = 0)"
    ladders = {
        "django": [("planned", "contains(planned, 'runtests.py')", "planned"), ("converted", "contains(planned, 'pytest') AND len(conv) > 0", dj("conv")), ("modules", "len(mods) > 0", dj("mods")), ("tests", "len(tops) > 0", f"CASE WHEN len(tops6) > 0 THEN {dj('tops6')} ELSE {last} END"), ("patch", "len(of_paths) > 0", f"CASE WHEN len({short('of_paths')}) > 0 THEN {dj(short('of_paths'))} ELSE {last} END"), ("target", f"len({short('of_target')}) > 0", dj(short("of_target"))), ("last", "TRUE", last)],
        "sympy": [("planned", "contains(planned, 'bin/test')", "planned"), ("converted", f"starts_with(planned, 'pytest ') AND len({pyw}) > 0", sy(pyw)), ("modules", "len(modules) > 0", sy("modules[1:6]")), ("tests", "len(sym) > 0", sy("sym")), ("patch", "len(of_paths) > 0", sy("of_paths[1:6]")), ("last", "TRUE", sy("['sympy/']"))],
        "pytest": [("tests", "len(fail || keep) > 0", py(files)), ("planned", "contains(planned, 'pytest')", "planned"), ("modules", "len(modules) > 0", py("modules[1:6]")), ("foreign", "mode = 'module_suite' AND planned <> '' AND NOT contains(planned, 'runtests.py')", "planned"), ("patch", "len(of_paths) > 0", py("of_paths", "")), ("target", "len(of_target) > 0", py("of_target", "")), ("last", "TRUE", "'pytest tests/ -v --tb=short -x'")],
        "unnamed_django": [("planned", "mode = 'module_suite' AND planned <> ''", "planned"), ("modules", f"mode = 'module_suite' AND len(list_filter(modules[1:6], lambda x: {allowed})) > 0", dj(f"list_filter(modules[1:6], lambda x: {allowed})")), ("fast", "mode = 'fast' AND len(ff) > 0 AND len(kl) > 0", dj(fast("ff", "kf", True))), ("tests", "len(valid) > 0 AND len(m2) > 0", dj("m2")), ("patch", "len(of_paths) > 0", dj("of_paths")), ("target", "len(of_target) > 0", dj("of_target")), ("seed", "contains(seed, '14787')", "'./tests/runtests.py decorators --verbosity=2'"), ("seed", "contains(seed, '11099')", "'./tests/runtests.py auth_tests.test_validators --verbosity=2'"), ("last", "TRUE", "'./tests/runtests.py decorators utils_tests.test_decorators --verbosity=2'")],
        "unnamed": [("planned", "mode = 'module_suite' AND planned <> '' AND NOT contains(planned, 'runtests.py')", "planned"), ("modules", "mode = 'module_suite' AND len(modules) > 0", py("modules[1:6]")), ("fast", "mode = 'fast' AND any_keep AND len(valid) > 0", py(fast("valid", "valid_keep", False))), ("tests", "len(valid) > 0", py("valid")), ("patch", "len(of_paths) > 0", py("of_paths", "")), ("target", "len(of_target) > 0", py("of_target", "")), ("last", "TRUE", "'pytest tests/ -v --tb=short -x'")],
    }
    cases = " ".join(f"WHEN kind = '{k}' THEN CASE {some(ladder)} END" for k, ladder in ladders.items()).replace("{{", "{").replace("}}", "}")
    said = lambda col: f"list_filter(coalesce({col}, []), lambda t: trim(t) <> '')"
    valid = lambda col: f"list_filter(list_transform({col}, lambda t: trim(t)), lambda t: t NOT IN {holders})"
    names = lambda col: f"list_filter(list_transform({col}, lambda t: {dotted}), lambda t: {is_label})"
    sql = f"""WITH a AS (SELECT o_orderkey, {fixture} FROM orders),
b AS (SELECT o_orderkey, seed, own_command, trim(coalesce(planned_command, '')) AS planned, list_filter(coalesce(planned_modules, []), lambda x: x <> '') AS modules, {said('fail')} AS fail, {said('keep')} AS keep, len(coalesce(keep, [])) > 0 AS any_keep,
  CASE WHEN coalesce(repo, '') = '' THEN NULL WHEN starts_with(repo, 'own/') THEN 'generic' ELSE repo END AS profile, CASE WHEN mode IN ('min', 'Fast ') THEN 'fast' ELSE 'module_suite' END AS mode,
  {_uniq("list_transform(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, '--- a/') OR starts_with(x, '+++ b/')), lambda x: x[7:])")} AS paths, CASE WHEN contains(target, ':') THEN [string_split(target, ':')[1]] ELSE [] END AS targets FROM a),
c AS (SELECT *, CASE WHEN profile = 'django/django' THEN 'django' WHEN profile = 'sympy/sympy' THEN 'sympy' WHEN profile IS NOT NULL THEN 'pytest' WHEN contains(lower(seed), 'django') THEN 'unnamed_django' ELSE 'unnamed' END AS kind FROM b),
e AS (SELECT *, {_tests('paths')} AS all_paths, {_tests('targets')} AS all_targets, {valid('fail')} AS valid, {valid('keep')} AS valid_keep FROM c),
f AS (SELECT *, {_uniq('all_paths')} AS of_paths, {_uniq('all_targets')} AS of_target, {names('valid')} AS fl, {names('valid_keep')} AS kl, {conv} AS conv, {mods} AS mods, {tops} AS tops FROM e),
g AS (SELECT *, list_filter(fl, lambda t: NOT {bad}) AS ff, list_filter(kl, lambda t: NOT {bad}) AS kf, {short('tops')} AS tops6, {sym} AS sym, {merged} AS m0 FROM f),
h AS (SELECT *, {only_dotted} AS m1 FROM g), i AS (SELECT *, {pruned} AS m2 FROM h),
j AS (SELECT o_orderkey, CASE WHEN own_command IS NOT NULL THEN {{'strategy': 'own', 'command': own_command}} {cases} END AS s FROM i)
SELECT o_orderkey, s.strategy AS strategy, s.command AS command FROM j"""
    return _written_out(sql)


@query(_command_sql())
def test_commands(spark, d):
    """The command that runs the tests of a change, and the strategy that gave it."""
    rows = table(spark, d, "orders").select("o_orderkey", *[F.expr(e).alias(c) for c, e in _lists(False).items()])
    return commands.commands_of(rows).select("o_orderkey", "strategy", "command")

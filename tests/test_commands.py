"""The command of each strategy, kind by kind, as written down by hand; conventions and labels; nulls and empty rows."""

from pyspark.sql import functions as F

from faultline.functions import commands, profiles

COLUMNS = "id int, repo string, seed string, mode string, own_command string, planned_command string, planned_modules array<string>, fail array<string>, keep array<string>, patch string, target string"
SYMPY = "PYTHONWARNINGS='ignore::UserWarning,ignore::SyntaxWarning' bin/test -C --verbose "


def patch(path):
    return f"--- a/{path}\n+++ b/{path}\n@@ -1 +1 @@\n-a\n+b\n"


#: (strategy, command, fields)
GOLDEN = [
    ("own", "make check", dict(repo="django/django", own_command="make check", planned_command="./tests/runtests.py a")),
    ("planned", "./tests/runtests.py a b", dict(repo="django/django", planned_command=" ./tests/runtests.py a b ")),
    ("converted", "./tests/runtests.py auth_tests mail --verbosity=2", dict(repo="django/django", planned_command="python -m pytest tests/auth_tests/test_a.py::X::y tests/gis_tests/b.py tests/mail/tests.py -q")),
    ("modules", "./tests/runtests.py mail cache --verbosity=2", dict(repo="Django/Django", planned_command="tox", planned_modules=["tests/mail/tests.py", "gis_tests", "a b", "cache", "cache"])),
    ("tests", "./tests/runtests.py decorators forms_tests auth --verbosity=2", dict(repo="django/django", fail=["tests/decorators/tests.py::A::test_a", " forms_tests.tests.F.test_y "], keep=["auth.tests.T.test_z"])),
    ("tests", "./tests/runtests.py decorators --verbosity=2", dict(repo="django/django", mode="fast", fail=["decorators.tests.A.test_a"], keep=["auth.tests.T.test_z"])),
    ("tests", "./tests/runtests.py decorators utils_tests --verbosity=2", dict(repo="django/django", fail=["gis_tests.tests.G.test_z"], patch=patch("django/forms/a.py"))),
    ("patch", "./tests/runtests.py forms_tests model_forms model_formsets --verbosity=2", dict(repo="django/django", patch=patch("django/forms/a.py"))),
    ("target", "./tests/runtests.py queries model_fields expressions --verbosity=2", dict(repo="django/django", target="django/db/models/q.py:f")),
    ("last", "./tests/runtests.py decorators utils_tests --verbosity=2", dict(repo="django/django")),
    ("planned", "bin/test a.py", dict(repo="sympy/sympy", planned_command="bin/test a.py")),
    ("converted", SYMPY + "sympy/a/tests/test_b.py", dict(repo="sympy/sympy", planned_command="pytest sympy/a/tests/test_b.py c.py -q")),
    ("modules", SYMPY + "x y", dict(repo="sympy/sympy", planned_command="tox", planned_modules=["x", "", "y"])),
    ("tests", SYMPY + "a.py sympy/core/tests/test_add.py", dict(repo="sympy/sympy", fail=["a.py::test_x", "test_add"], target="sympy/core/_add.py:f")),
    ("patch", SYMPY + "sympy/core/tests/test_mul.py", dict(repo="sympy/sympy", fail=["test_mul"], patch=patch("sympy/core/mul.py"))),
    ("last", SYMPY + "sympy/", dict(repo="sympy/sympy", target="nothing")),
    ("tests", "pytest a.py b.py -v --tb=short", dict(repo="psf/requests", fail=["a.py::C::m", "a.py::C::n"], keep=["b.py::k"], planned_command="pytest z.py")),
    ("planned", "pytest z.py", dict(repo="psf/requests", planned_command="pytest z.py", planned_modules=["q.py"])),
    ("modules", "pytest q.py -v --tb=short", dict(repo="psf/requests", planned_command="tox", planned_modules=["q.py"])),
    ("foreign", "tox", dict(repo="psf/requests", planned_command="tox", patch=patch("requests/models.py"))),
    ("patch", "pytest test_requests.py -v", dict(repo="psf/requests", mode="min", planned_command="tox", patch=patch("requests/models.py"))),
    ("target", "pytest testing/test_mark.py testing/test_mark_expression.py -v", dict(repo="pytest-dev/pytest", target="src/_pytest/mark/x.py:f")),
    ("last", "pytest tests/ -v --tb=short -x", dict(repo="own/thing", planned_command="./tests/runtests.py a")),
    ("planned", "tox", dict(seed="django__django-1", planned_command="tox")),
    ("modules", "./tests/runtests.py mail --verbosity=2", dict(seed="django__django-1", planned_modules=["mail", "gis_tests.a"])),
    ("fast", "./tests/runtests.py a.b.C.test_1 x.y.Z.test_q a.b.C.test_2 --verbosity=2", dict(seed="django__django-1", mode="fast", fail=["a.b.C.test_1", "a.b.C.test_2", "a.BaseXTests.test_3"], keep=["x.BaseZTest.test_p", "x.y.Z.test_q"])),
    ("tests", "./tests/runtests.py a.b utils_tests.test_text x.y --verbosity=2", dict(seed="django__django-1", fail=["a.b.C.test_1", "test_bug"], keep=["x.y.Z.test_q"], patch=patch("django/utils/text.py"))),
    ("patch", "./tests/runtests.py handlers --verbosity=2", dict(seed="django__django-1", fail=["test_bug"], patch=patch("django/core/handlers/base.py"))),
    ("target", "./tests/runtests.py middleware --verbosity=2", dict(seed="django__django-1", target="django/middleware/a.py:f")),
    ("seed", "./tests/runtests.py decorators --verbosity=2", dict(seed="django__django-14787")),
    ("seed", "./tests/runtests.py auth_tests.test_validators --verbosity=2", dict(seed="django__django-11099", patch=patch("setup.py"))),
    ("last", "./tests/runtests.py decorators utils_tests.test_decorators --verbosity=2", dict(seed="django__django-1")),
    ("fast", "pytest a.py::x k.py::z -v --tb=short", dict(mode="minimal", fail=["a.py::x", "b.py::y"], keep=["k.py::z", "k.py::w"])),
    ("tests", "pytest a.py::x b.py::y -v --tb=short", dict(fail=["a.py::x", "test_synthetic", " b.py::y"])),
    ("patch", "pytest tests/test_b.py -v", dict(patch=patch("a/b.py"))),
    ("target", "pytest a/test_b.py -v", dict(target="a/test_b.py:f")),
    ("last", "pytest tests/ -v --tb=short -x", dict()),
]


def rows_of(spark, cases):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple({"id": i, **fields}.get(c) for c in names) for i, fields in enumerate(cases)], COLUMNS)


def test_each_strategy(spark):
    found = {r.id: (r.strategy, r.command) for r in commands.commands_of(rows_of(spark, [g[2] for g in GOLDEN])).collect()}
    assert [(i, *found[i]) for i in range(len(GOLDEN))] == [(i, s, c) for i, (s, c, _) in enumerate(GOLDEN)]


def test_lists_are_cut_and_nulls_skipped(spark):
    many = [f"t{i}.py::x" for i in range(9)]
    rows = rows_of(spark, [dict(repo="psf/requests", fail=[None, "", *many]), dict(mode="fast", fail=many, keep=many[::-1])])
    got = [r.command for r in commands.commands_of(rows.coalesce(1), most_fail=2, most_keep=5, most=4).collect()]
    assert got[0] == "pytest t0.py t1.py t2.py t3.py -v --tb=short"
    # two failing ones, then tests that stay until four are chosen
    assert got[1] == "pytest t0.py::x t1.py::x t8.py::x t7.py::x -v --tb=short"


def test_empty_table_and_clashing_columns(spark):
    rows = rows_of(spark, []).withColumn("kind", F.lit("mine")).withColumn("profile", F.lit(1))
    assert commands.commands_of(rows).collect() == []
    one = rows_of(spark, [dict(repo="sympy/sympy")]).withColumn("kind", F.lit("mine")).withColumn("valid", F.lit(2))
    assert [(r.kind, r.valid, r.strategy) for r in commands.commands_of(one).collect()] == [("mine", 2, "last")]


def test_conventions(spark):
    cases = [
        ("sphinx-doc/sphinx", "sphinx/ext/napoleon/docstring.py", ["tests/test_ext_napoleon_docstring.py", "tests/test_ext_napoleon.py", "tests/test_ext.py"]),
        ("sphinx-doc/sphinx", "sphinx/pycode/__init__.py", ["tests/test_pycode.py"]),
        ("sphinx-doc/sphinx", "sphinx/__init__.py", ["tests/test_init__.py"]),
        ("sphinx-doc/sphinx", "sphinx/builders/html.py", ["tests/test_build_html.py", "tests/test_builders_html.py", "tests/test_builders.py"]),
        ("pylint-dev/pylint", "pylint/reporters/text.py", ["tests/reporters/unittest_reporting.py", "tests/reporters/unittest_text.py"]),
        ("scikit-learn/scikit-learn", "sklearn/ensemble/_forest.py", ["sklearn/ensemble/tests/test_forest.py"]),
        ("matplotlib/matplotlib", "lib/mpl_toolkits/axes/a.py", ["lib/mpl_toolkits/axes/tests/test_a.py"]),
        ("generic", "a.py", ["./tests/test_a.py", "./test_a.py", "tests/test_a.py", "test_a.py"]),
    ]
    rows = spark.createDataFrame(cases, "profile string, path string, want array<string>")
    bad = rows.where(~profiles.usual_tests(F.col("profile"), F.col("path")).eqNullSafe(F.col("want")))
    assert bad.collect() == []

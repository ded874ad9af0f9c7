"""Profiles of repositories: how their tests are run and where the tests of a source file lie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By profile, what runs its tests, the folder of tests and the command; others have those of 'generic'.
FRAMEWORKS = {
    "django/django": ("unittest", "tests", "./tests/runtests.py {} --verbosity=2"),
    "sympy/sympy": ("sympy_bin_test", "sympy", "PYTHONWARNINGS='ignore::UserWarning,ignore::SyntaxWarning' bin/test -C --verbose {}"),
    "pytest-dev/pytest": ("pytest", "testing", "pytest {} -v --tb=short"),
    "scikit-learn/scikit-learn": ("pytest", "sklearn", "pytest {} -v --tb=short"),
    "matplotlib/matplotlib": ("pytest", "lib/matplotlib/tests", "pytest {} -v --tb=short"),
    "astropy/astropy": ("pytest", "astropy", "pytest {} -v --tb=short"),
    "pydata/xarray": ("pytest", "xarray/tests", "pytest {} -v --tb=short"),
    "sphinx-doc/sphinx": ("pytest", "tests", "pytest {} -v --tb=short"),
    "psf/requests": ("pytest", "tests", "pytest {} -v --tb=short"),
    "pylint-dev/pylint": ("pytest", "tests", "pytest {} -v --tb=short"),
    "generic": ("pytest", "tests", "pytest {} -v --tb=short"),
}
#: Parts of source paths and the tests that go with them, in the order in which they are tried.
TESTS_OF_PATHS = {
    "django/django": {
        "django/utils/decorators.py": ["decorators", "utils_tests.test_decorators"],
        "django/utils/text.py": ["utils_tests.test_text"],
        "django/core/handlers/": ["handlers"],
        "django/contrib/sites/": ["sites_tests", "sites_framework"],
        "django/views/decorators/": ["decorators"],
        "django/contrib/auth/": ["auth_tests"],
        "django/contrib/admin/": ["admin_views", "admin_checks", "admin_utils", "modeladmin"],
        "django/forms/": ["forms_tests", "model_forms", "model_formsets"],
        "django/db/models/": ["queries", "model_fields", "expressions"],
        "django/db/": ["db_functions", "db_utils", "backends"],
        "django/template/": ["template_tests", "templates"],
        "django/utils/": ["utils_tests"],
        "django/core/": ["cache", "mail", "validators"],
        "django/views/": ["view_tests", "generic_views"],
        "django/http/": ["httpwrappers", "requests", "responses"],
        "django/middleware/": ["middleware"],
        "django/urls/": ["urlpatterns", "urlpatterns_reverse"],
    },
    "pytest-dev/pytest": {
        "src/_pytest/config/": ["testing/test_config.py"],
        "src/_pytest/fixtures.py": ["testing/python/fixtures.py", "testing/python/test_fixtures.py", "testing/test_fixtures.py"],
        "src/_pytest/assertion/": ["testing/test_assertion.py", "testing/python/approx.py"],
        "src/_pytest/logging.py": ["testing/logging/test_fixture.py"],
        "src/_pytest/capture.py": ["testing/test_capture.py"],
        "src/_pytest/cacheprovider.py": ["testing/test_cacheprovider.py"],
        "src/_pytest/python.py": ["testing/python/test_python.py", "testing/python/metafunc.py", "testing/python/collect.py", "testing/python/fixtures.py", "testing/python/integration.py", "testing/python/approx.py", "testing/python/raises.py", "testing/python/show_fixtures_per_test.py"],
        "src/_pytest/terminal.py": ["testing/test_terminal.py"],
        "src/_pytest/nodes.py": ["testing/test_nodes.py"],
        "src/_pytest/mark/": ["testing/test_mark.py", "testing/test_mark_expression.py"],
        "src/_pytest/runner.py": ["testing/test_runner.py"],
        "src/_pytest/skipping.py": ["testing/test_skipping.py"],
        "src/_pytest/tmpdir.py": ["testing/test_tmpdir.py"],
        "src/_pytest/pathlib.py": ["testing/test_pathlib.py"],
        "src/_pytest/doctest.py": ["testing/test_doctest.py"],
        "src/_pytest/warnings.py": ["testing/test_warnings.py"],
        "src/_pytest/stepwise.py": ["testing/test_stepwise.py"],
        "src/_pytest/recwarn.py": ["testing/test_recwarn.py"],
        "src/_pytest/monkeypatch.py": ["testing/test_monkeypatch.py"],
        "src/_pytest/outcomes.py": ["testing/python/raises.py"],
        "src/_pytest/approx.py": ["testing/python/approx.py"],
    },
    "psf/requests": {
        "requests/models.py": ["test_requests.py"],
        "requests/api.py": ["test_requests.py"],
        "requests/sessions.py": ["test_requests.py"],
        "requests/auth.py": ["test_requests.py"],
        "requests/cookies.py": ["test_requests.py"],
        "requests/utils.py": ["test_requests.py"],
        "requests/structures.py": ["test_requests.py"],
        "requests/packages/urllib3": ["test_requests.py"],
    },
    "pydata/xarray": {"xarray/core/alignment.py": ["xarray/tests/test_dataarray.py", "xarray/tests/test_dataset.py"]},
}
#: Modules of tests that end the run of a profile, and further signs of a crash.
DISALLOWED = {"django/django": ("gis_tests",)}
CRASH_SIGNS = {
    "django/django": (
        ("django.setup()", "django_setup_crash"),
        ("apps.populate(", "apps_populate_crash"),
        ("SystemCheckError:", "system_check_error"),
        ("System check identified", "system_check_error"),
    ),
}


def _by_profile(profile: Column, values: dict, other=None) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(profile == name, value) if out is None else out.when(profile == name, value)
    return out if other is None else out.otherwise(other)


def settings(profile: Column) -> Column:
    """struct(framework, test_root, template, disallowed, crash_signs) of a profile; those of 'generic' for other names and null."""
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    known = {p: F.struct(F.lit(f).alias("framework"), F.lit(r).alias("test_root"), F.lit(t).alias("template"), texts(DISALLOWED.get(p, ())).alias("disallowed"), texts(s for s, _ in CRASH_SIGNS.get(p, ())).alias("crash_signs")) for p, (f, r, t) in FRAMEWORKS.items()}
    entries = F.create_map(*[x for name, value in known.items() for x in (F.lit(name), value)])
    return F.try_element_at(entries, F.when(profile.isin(*known), profile).otherwise("generic"))


def parts(path: Column) -> tuple[Column, Column]:
    """The folder of a path ('.' without one) and the stem of its name without leading underscores."""
    folder, name = F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.substring_index(path, "/", -1)
    return F.when(folder == "", ".").otherwise(folder), F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), "^_+", "")


def stated_tests(profile: Column, path: Column) -> Column:
    """The tests that a profile states for the first part that the path holds; null if it states none."""
    rules = {p: F.coalesce(*[F.when(path.contains(part), F.array(*map(F.lit, tests))) for part, tests in stated.items()]) for p, stated in TESTS_OF_PATHS.items()}
    return _by_profile(profile, rules)


def usual_tests(profile: Column, path: Column) -> Column:
    """The files where the convention of a profile looks for the tests of a source file, the likeliest first. Most profiles take a test file as its own."""
    folder, stem = parts(path)
    at = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs], F.lit(".py"))
    below, own = at(folder, "/tests/test_", stem), F.array(path)
    in_tests, in_root = path.contains("/tests/"), path.startswith("tests/")
    # a path below the package, by all its folders, by all but the last, and so on: a/b/c.py as a_b_c, a_b, a
    steps = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^sphinx/", ""), r"(?<=[^/])\.py$", ""), "(^|/)__init__$", ""), "/")
    names = F.transform(F.reverse(F.sequence(F.lit(1), F.size(steps))), lambda i: at("tests/test_", F.array_join(F.slice(steps, 1, i), "_")))
    package = F.when(path.startswith("sphinx/") & (steps[0] != ""), names).otherwise(F.array().cast("array<string>"))
    built = F.when(path.contains("builders") & (stem != ""), F.array(at("tests/test_build_", stem))).otherwise(F.array().cast("array<string>"))
    documented = F.concat(built, package)
    here = F.array(below)
    rules = {
        "sympy/sympy": F.when(in_tests, own).otherwise(here),
        "scikit-learn/scikit-learn": F.when(in_tests, own).otherwise(here),
        "astropy/astropy": F.when(in_tests, own).otherwise(here),
        "matplotlib/matplotlib": F.when(in_tests, own).when(path.startswith("lib/mpl_toolkits/"), here).otherwise(F.array(at("lib/matplotlib/tests/test_", stem))),
        "pydata/xarray": F.when(in_tests, own).otherwise(F.array(at("xarray/tests/test_", stem))),
        "pytest-dev/pytest": F.array(at("testing/test_", stem), at("testing/python/test_", stem), at("testing/python/", stem)),
        "psf/requests": F.when(in_root | path.startswith("test_"), own).otherwise(F.array(at("test_", stem), at("tests/test_", stem), F.lit("test_requests.py"), F.lit("tests/test_requests.py"))),
        "sphinx-doc/sphinx": F.when(in_root, own).when(F.size(documented) > 0, documented).otherwise(F.array(at("tests/test_", stem))),
        "pylint-dev/pylint": F.when(in_root, own)
        .when(path.startswith("pylint/checkers/"), F.array(at("tests/checkers/unittest_", stem), at("tests/checkers/test_", stem)))
        .when(path.startswith("pylint/pyreverse/"), F.array(at("tests/unittest_pyreverse_", stem), at("tests/pyreverse/test_", stem), at("tests/pyreverse/unittest_", stem)))
        .when(path.startswith("pylint/reporters/"), F.array(F.lit("tests/reporters/unittest_reporting.py"), at("tests/reporters/unittest_", stem)))
        .otherwise(F.array(at("tests/unittest_", stem), at("tests/test_", stem))),
        "django/django": F.array(below, at(folder, "/test_", stem), at("tests/test_", stem)),
    }
    return _by_profile(profile, rules, F.array(below, at(folder, "/test_", stem), at("tests/test_", stem), at("test_", stem)))


def tests_of(profile: Column, path: Column) -> Column:
    """The tests of a source file: those that the profile states, else the likeliest of its convention."""
    return F.coalesce(stated_tests(profile, path), F.slice(usual_tests(profile, path), 1, 1))


def label_of(profile: Column, test_file: Column) -> Column:
    """A test file as what its framework takes: a dotted label for unittest, else the path."""
    bare = F.regexp_replace(F.regexp_replace(test_file, r"^\./", ""), "^tests/", "")
    dotted = F.regexp_replace(F.replace(F.replace(bare, F.lit(".py"), F.lit("")), F.lit("/"), F.lit(".")), r"\.+$", "")
    return F.when(profile == "django/django", dotted).otherwise(test_file)


def path_of_label(label: Column, root: Column) -> Column:
    """The inverse: a dotted label as the test id of a runner that takes paths, below the root: the file ends before the first part in upper case or, from the third part on, one that starts with test_ and is the last."""
    names = F.split(label, r"\.")
    n = F.size(names)
    kinds = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(names, i).rlike("^[A-Z]") | ((i == n) & (i >= 3) & F.element_at(names, i).startswith("test_")))
    cut = F.coalesce(F.element_at(F.when(F.size(kinds) > 0, kinds), 1), n + 1)
    file = F.concat(root, F.lit("/"), F.array_join(F.slice(names, 1, cut - 1), "/"), F.lit(".py"))
    rest = F.array_join(F.slice(names, cut, F.greatest(n - cut + 1, F.lit(0))), "::")
    return F.when(label.contains("/") | (cut == 1), label).when(rest == "", file).otherwise(F.concat(file, F.lit("::"), rest))

"""The command that runs the tests of a change: strategies in the order of their kind of repository, the first that has a target wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labels, profiles

#: Names that stand for a test that is not there.
PLACEHOLDERS = ("test_reproduce_bug", "test_synthetic", "test_bug", "test_method", "test_view")
#: What is run when nothing else is known.
LAST_DJANGO = "./tests/runtests.py decorators utils_tests --verbosity=2"
LAST_DJANGO_SEEDS = {"14787": "./tests/runtests.py decorators --verbosity=2", "11099": "./tests/runtests.py auth_tests.test_validators --verbosity=2"}
LAST_DJANGO_UNNAMED = "./tests/runtests.py decorators utils_tests.test_decorators --verbosity=2"
LAST_PYTEST = "pytest tests/ -v --tb=short -x"
LAST_SYMPY = "sympy/"

DJANGO, SYMPY = "django/django", "sympy/sympy"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _texts(x: Column) -> Column:
    """The texts of a list that say something; none for null."""
    return F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda t: t.isNotNull() & (_strip(t) != ""))


def _run(template: str, targets: Column) -> Column:
    """The command with its targets; null without any."""
    before, after = template.split("{}")
    return F.when(F.size(targets) > 0, F.concat(F.lit(before), F.array_join(targets, " "), F.lit(after)))


def changed_paths(patch: Column) -> Column:
    """The paths that the headers of a patch name, in order, each once."""
    lines = F.filter(F.split(F.coalesce(patch, F.lit("")), "\n"), lambda x: x.startswith("--- a/") | x.startswith("+++ b/"))
    return F.array_distinct(F.filter(F.transform(lines, lambda x: _strip(F.substring(x, 7, 1 << 30))), lambda x: (x != "") & (x != "/dev/null")))


def _is_label(x: Column) -> Column:
    return ~x.rlike(r"[ \t\n/]") & x.contains(".") & ~x.rlike("^(Traceback|ERROR|FAIL)")


def _top(x: Column) -> Column:
    return F.substring_index(x, ".", 1)


def _allowed(x: Column) -> Column:
    hits = [(x == p) | x.startswith(p + ".") for p in profiles.DISALLOWED[DJANGO]]
    return ~F.greatest(*hits, F.lit(False))


def _dotted_top(path: Column) -> Column:
    """The first part of a test file as a dotted label."""
    return _top(F.regexp_replace(F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit(".py"), F.lit("")), r"^tests\.", ""))


def _is_path(x: Column) -> Column:
    return x.contains("/") | x.endswith(".py")


def fast_choice(fail: Column, keep: Column, most_fail: int, most_keep: int, most: int, fill: bool) -> Column:
    """The first tests that are to fail, then tests that are to stay passing until enough of those are chosen; `fill` takes more of the failing ones while there is room."""
    first = F.array_distinct(F.slice(fail, 1, most_fail))

    def add(state, t):
        chosen = F.when(F.array_contains(state["chosen"], t), state["chosen"]).otherwise(F.concat(state["chosen"], F.array(t)))
        full = state["full"] | (F.size(state["chosen"]) >= most)
        enough = F.size(F.filter(chosen, lambda c: F.array_contains(keep, c))) >= most_keep
        return F.struct(F.when(full, state["chosen"]).otherwise(chosen).alias("chosen"), (full | enough).alias("full"))

    chosen = F.aggregate(keep, F.struct(first.alias("chosen"), F.lit(False).alias("full")), add, lambda s: s["chosen"])
    room = F.slice(F.array_distinct(F.concat(chosen, fail)), 1, most)
    return F.when(F.size(chosen) < most, room).otherwise(chosen) if fill else chosen


def commands_of(rows: DataFrame, most_fail: int = 1, most_keep: int = 1, most: int = 6) -> DataFrame:
    """rows with strategy and command, chosen row by row without a shuffle.

    rows: repo, seed, mode, own_command, planned_command, planned_modules, fail, keep (lists of tests), patch, target (path:name). Any may be null.
    A command of its own is taken as it is. A repository has the ladder of its profile; a row without one that of its seed's kind. Modes are
    fast (min, minimal) and module_suite (suite, module, null). Files of a patch are taken in the order in which its headers name them. The
    profile of the row, never another, says which tests a source file has.
    """
    c, cut = F.col, lambda x: F.slice(x, 1, most)
    none = F.array().cast("array<string>")
    m = _strip(F.lower(F.coalesce("mode", F.lit(""))))
    named = F.trim(F.coalesce("repo", F.lit(""))) != ""
    profile = F.when(named, labels.profile_of(c("repo")))
    out = rows.select(F.struct("*").alias("__row"), profile.alias("profile"), F.coalesce(c("seed"), F.lit("")).alias("seed"), "own_command", _strip(F.coalesce("planned_command", F.lit(""))).alias("planned"),
        F.filter(F.coalesce("planned_modules", none), lambda x: x.isNotNull() & (x != "")).alias("modules"), _texts(c("fail")).alias("fail"), _texts(c("keep")).alias("keep"), (F.size(F.coalesce("keep", none)) > 0).alias("any_keep"),
        changed_paths(c("patch")).alias("paths"), F.when(c("target").contains(":"), F.substring_index("target", ":", 1)).alias("target"),
        F.when(m.isin("min", "minimal"), "fast").when(m.isin("suite", "module", ""), "module_suite").otherwise(m).alias("mode"))
    kind = F.when(c("profile") == DJANGO, "django").when(c("profile") == SYMPY, "sympy").when(c("profile").isNotNull(), "pytest").when(F.lower("seed").contains("django"), "unnamed_django").otherwise("unnamed")
    out = out.withColumn("kind", kind)

    def plain_tests(p: Column) -> Column:
        other = F.when(p.contains("test"), p).otherwise(F.concat(F.lit("tests/test_"), F.replace(F.substring_index(p, "/", -1), F.lit(".py"), F.lit("")), F.lit(".py")))
        unnamed = F.when(c("kind") == "unnamed_django", F.coalesce(profiles.stated_tests(F.lit(DJANGO), p), none)).otherwise(F.array(other))
        return F.when(c("profile").isNull(), unnamed).otherwise(profiles.tests_of(c("profile"), p))

    valid = lambda x: F.filter(F.transform(x, _strip), lambda t: ~t.isin(*PLACEHOLDERS))
    out = out.withColumns({"of_paths": F.array_distinct(F.flatten(F.transform("paths", plain_tests))), "of_target": F.when(c("target").isNotNull(), plain_tests(c("target"))).otherwise(none), "valid": valid(c("fail")), "valid_keep": valid(c("keep"))})
    as_labels = lambda x: F.filter(F.transform(x, labels.to_dotted), _is_label)
    runnable = lambda x: F.filter(x, lambda t: ~F.exists(F.split(t, r"\."), lambda p: p.rlike("^Base.*Test")))
    out = out.withColumns({"fail_labels": as_labels(c("valid")), "keep_labels": as_labels(c("valid_keep"))})
    out = out.withColumns({"fail_fast": runnable(c("fail_labels")), "keep_fast": runnable(c("keep_labels"))})
    django, sympy, pytest = (profiles.FRAMEWORKS[p][2] for p in (DJANGO, SYMPY, "generic"))
    suite, fast = c("mode") == "module_suite", c("mode") == "fast"

    # of the profile for unittest: everything becomes the first part of a dotted label
    words = F.filter(F.split("planned", r"\s+"), lambda w: ~w.startswith("-") & ~w.isin("pytest", "python", "-m", ""))
    word_tops = F.transform(F.filter(F.transform(words, lambda w: F.substring_index(w, "::", 1)), _is_path), _dotted_top)
    converted = cut(F.array_distinct(F.filter(word_tops, lambda x: (x != "") & _allowed(x))))
    module_tops = F.transform("modules", lambda x: F.when(_is_path(x) & (_dotted_top(x) != ""), _dotted_top(x)).otherwise(x))
    planned_tops = cut(F.array_distinct(F.filter(module_tops, lambda x: ~x.rlike(r"[ \t\n]") & _allowed(x))))

    def top_of(test: Column) -> Column:
        t = _strip(test)
        moved = F.regexp_replace(F.replace(F.replace(t, F.lit("::"), F.lit(".")), F.lit("/"), F.lit(".")), r"^tests\.", "")
        return F.when(~t.contains("::") & t.contains(".") & ~t.contains("/"), t).otherwise(F.regexp_replace(F.replace(moved, F.lit(".py."), F.lit(".")), r"^\.+|\.+$", ""))

    tops = F.array_distinct(F.filter(F.transform(F.filter(F.transform(F.concat("fail", F.when(suite, c("keep")).otherwise(none)), top_of), _is_label), _top), lambda x: x != ""))
    shortened = lambda x: cut(F.filter(F.array_distinct(F.transform(x, _top)), _allowed))

    # of the profile with its own runner: files; tests without a file are looked for beside the target
    every = F.transform(F.concat("fail", "keep"), _strip)
    pathless = F.exists(every, lambda t: ~t.contains("::") & ~_is_path(t))
    files = F.filter(F.transform(F.filter(every, lambda t: t.contains("::") | _is_path(t)), lambda t: F.substring_index(t, "::", 1)), lambda f: f != "")
    sympy_files = F.array_distinct(F.concat(files, F.when(pathless, c("of_target")).otherwise(none)))
    py_words = F.filter(F.split("planned", r"\s+"), lambda w: w.endswith(".py") & w.contains("/"))

    # of rows without a repository
    chosen_fail = F.when(fast & (F.size("fail_labels") > 0) & (F.size("keep_labels") > 0), none).otherwise(c("fail_labels"))
    own_modules = F.filter(F.transform(F.transform(chosen_fail, labels.collapse_label), lambda x: F.regexp_replace(F.regexp_replace(x, r"^tests\.(?=.)", ""), r"\.py$", "")), lambda x: (x != "") & ~x.endswith(".py"))
    inferred = F.when(F.size("paths") > 0, c("of_paths")).otherwise(c("of_target"))
    merged = F.array_sort(F.array_distinct(F.concat(own_modules, F.transform("keep_labels", labels.collapse_label), inferred)))
    seeds = F.coalesce(*[F.when(c("seed").contains(s), F.lit(cmd)) for s, cmd in LAST_DJANGO_SEEDS.items()])
    loose = "pytest {} -v"

    # what a ladder reads more than once is a column, filled for the rows of its kind
    of = lambda kind, x: F.when(c("kind") == kind, x)
    out = out.withColumns({"converted": of("django", F.when(c("planned").contains("pytest"), converted)), "planned_tops": of("django", planned_tops), "tops": of("django", tops), "sympy_files": of("sympy", cut(sympy_files)), "py_words": of("sympy", py_words), "merged": of("unnamed_django", merged),
        "short_paths": of("django", shortened(c("of_paths"))), "short_target": of("django", shortened(c("of_target")))})
    fast_labels = F.when((c("kind") == "unnamed_django") & fast & (F.size("fail_fast") > 0) & (F.size("keep_labels") > 0), fast_choice(c("fail_fast"), c("keep_fast"), most_fail, most_keep, most, True))
    fast_tests = F.when((c("kind") == "unnamed") & fast & c("any_keep") & (F.size("valid") > 0), fast_choice(c("valid"), c("valid_keep"), most_fail, most_keep, most, False))
    test_files = of("pytest", cut(F.array_distinct(F.transform(F.concat("fail", "keep"), lambda t: F.substring_index(t, "::", 1)))))
    out = out.withColumns({"chosen": F.coalesce(fast_labels, fast_tests), "short_tops": shortened(c("tops")), "merged": labels.pruned(c("merged")), "test_files": test_files})
    ladders = {
        "django": [
            ("planned", F.when(c("planned").contains("runtests.py"), c("planned"))),
            ("converted", _run(django, c("converted"))),
            ("modules", _run(django, c("planned_tops"))),
            ("tests", F.when(F.size("tops") > 0, F.coalesce(_run(django, c("short_tops")), F.lit(LAST_DJANGO)))),
            ("patch", F.when(F.size("of_paths") > 0, F.coalesce(_run(django, c("short_paths")), F.lit(LAST_DJANGO)))),
            ("target", _run(django, c("short_target"))),
            ("last", F.lit(LAST_DJANGO)),
        ],
        "sympy": [
            ("planned", F.when(c("planned").contains("bin/test"), c("planned"))),
            ("converted", F.when(c("planned").startswith("pytest "), _run(sympy, c("py_words")))),
            ("modules", _run(sympy, cut(c("modules")))),
            ("tests", _run(sympy, c("sympy_files"))),
            ("patch", _run(sympy, cut(c("of_paths")))),
            ("last", F.lit(sympy.replace("{}", LAST_SYMPY))),
        ],
        "pytest": [
            ("tests", _run(pytest, c("test_files"))),
            ("planned", F.when(c("planned").contains("pytest"), c("planned"))),
            ("modules", _run(pytest, cut(c("modules")))),
            ("foreign", F.when(suite & (c("planned") != "") & ~c("planned").contains("runtests.py"), c("planned"))),
            ("patch", _run(loose, c("of_paths"))),
            ("target", _run(loose, c("of_target"))),
            ("last", F.lit(LAST_PYTEST)),
        ],
        "unnamed_django": [
            ("planned", F.when(suite & (c("planned") != ""), c("planned"))),
            ("modules", F.when(suite, _run(django, F.filter(cut(c("modules")), _allowed)))),
            ("fast", _run(django, c("chosen"))),
            ("tests", F.when(F.size("valid") > 0, _run(django, c("merged")))),
            ("patch", _run(django, c("of_paths"))),
            ("target", _run(django, c("of_target"))),
            ("seed", seeds),
            ("last", F.lit(LAST_DJANGO_UNNAMED)),
        ],
        "unnamed": [
            ("planned", F.when(suite & (c("planned") != "") & ~c("planned").contains("runtests.py"), c("planned"))),
            ("modules", F.when(suite, _run(pytest, cut(c("modules"))))),
            ("fast", _run(pytest, c("chosen"))),
            ("tests", _run(pytest, c("valid"))),
            ("patch", _run(loose, c("of_paths"))),
            ("target", _run(loose, c("of_target"))),
            ("last", F.lit(LAST_PYTEST)),
        ],
    }
    steps = [F.when(c("own_command").isNotNull(), F.struct(F.lit("own").alias("strategy"), c("own_command").alias("command")))]
    for name, ladder in ladders.items():
        found = F.coalesce(*[F.when(cmd.isNotNull(), F.struct(F.lit(step).alias("strategy"), cmd.alias("command"))) for step, cmd in ladder])
        steps.append(F.when(c("kind") == name, found))
    return out.select("__row", F.coalesce(*steps).alias("__c")).select("__row.*", "__c.strategy", "__c.command")

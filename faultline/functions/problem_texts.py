"""Problem texts without a language model: three levels from a chain and a traceback, mixtures of a given text with test output, and a sliding amount of information."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names
from .logs import strip
from .scalars import bound, chain_signals, identifier_density, identifiers, sentences, tokens, type_token_ratio

LEVELS = ("L1", "L2", "L3")
#: How a kind of exception is put into words, by a part of its name, in order.
L1_WORDS = (
    ("Assertion", "Certain operations produce incorrect results."),
    ("Type", "A type-related error occurs during processing."),
    ("Attribute", "An attribute access fails unexpectedly."),
    ("Value", "An operation receives or produces an invalid value."),
    ("Key", "A dictionary lookup fails for an expected key."),
)
CATEGORY_WORDS = (
    ("Assertion", "The tests report incorrect output values."),
    ("Type", "The operation encounters a type mismatch."),
    ("Attribute", "An attribute access fails unexpectedly."),
    ("Value", "The operation receives an invalid value."),
)
#: Words of sentences that tell behaviour, the parts of a text with the amount of information from which each is told, and texts that tell nothing.
BEHAVIOURS = ("instead", "expected", "returns", "produces", "should", "fails to", "incorrect", "wrong")
COMPONENTS = (("affected_area", 0.0), ("symptom_category", 0.2), ("behavioral_desc", 0.4), ("concrete_example", 0.6), ("exception_info", 0.7), ("source_hint", 0.8), ("traceback", 0.9))
EMPTY_TEXTS = ("Synthetic defect", "")
#: Words of a language that are no identifiers.
KEYWORDS = ("def", "class", "return", "import", "from", "if", "else", "elif", "for", "while", "try", "except", "finally", "with", "as", "pass", "break", "continue", "raise", "yield", "not", "and", "or", "is", "in", "True", "False", "None", "self", "lambda", "assert")


def _some(*parts: Column, sep: str = " ") -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def _listed(a: Column, n: int) -> Column:
    return F.array_join(F.slice(a, 1, n), ", ")


def _worded(kind: Column, table: tuple, other: Column) -> Column:
    return reduce(lambda c, kv: c.when(kind.contains(kv[0]), kv[1]), table[1:], F.when(kind.contains(table[0][0]), table[0][1])).otherwise(other)


def level_text(level: str, told: Column, summary: Column) -> Column:
    """The problem text of a level from what may be told (chains.exposed at that level) and a traceback summary (logs.traceback_summary)."""
    modules, classes, functions = told["modules"], told["classes"], told["functions"]
    kind, message, affected = summary["exception_type"], summary["exception_message"], summary["affected_modules"]
    raised, some = kind != "", F.size(modules) > 0
    many = lambda a, one, more: F.when(F.size(a) > 1, more).otherwise(one)
    area = F.when(some, F.concat(F.lit("An issue has been identified in the "), F.get(modules, 0), F.lit(" module.")))
    hidden = F.when(raised, _worded(kind, L1_WORDS, F.concat(F.lit("The operation raises a "), kind, F.lit(".")))).when(F.size(summary["assertion_messages"]) > 0, L1_WORDS[0][1]).otherwise("Unexpected behavior has been observed.")
    first = _some(area, hidden)
    if level == "L1":
        return first
    where = F.when(some, F.concat(F.lit("An issue has been identified in the "), _listed(modules, 3), F.lit(" module"), many(modules, ".", "s.")))
    involved = F.when(F.size(classes) > 0, F.concat(F.lit("The issue involves the "), _listed(classes, 2), F.lit(" class"), many(classes, ".", "es.")))
    brief = F.when(raised & (message != "") & (F.length(message) < 100), F.concat(F.lit("The operation raises "), kind, F.lit(": "), message)).when(raised, F.concat(F.lit("A "), kind, F.lit(" is raised during processing.")))
    tested = F.when(F.size(affected) > 0, F.concat(F.lit("This affects functionality tested in "), F.get(affected, 0), F.lit(".")))
    second = _some(where, involved, brief, tested)
    second = F.when(second == "", first).otherwise(second)
    if level == "L2":
        return second
    ticked = F.array_join(F.transform(F.slice(functions, 1, 3), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    full = F.when(some & (F.size(functions) > 0), F.concat(F.lit("The "), ticked, F.lit(" function"), many(functions, "", "s"), F.lit(" in the "), _listed(modules, 3), F.lit(" module"), many(modules, "", "s"), F.lit(" "), many(functions, "exhibits", "exhibit"), F.lit(" incorrect behavior.")))
    full = full.when(some, F.concat(F.lit("An issue has been identified in the "), _listed(modules, 3), F.lit(" module.")))
    through = F.when(F.size(classes) > 0, F.concat(F.lit("The issue manifests through the "), _listed(classes, 2), F.lit(" class.")))
    exact = F.when(raised & (message != ""), F.concat(F.lit("The operation raises `"), kind, F.lit(": "), message, F.lit("`."))).when(raised, F.concat(F.lit("A `"), kind, F.lit("` is raised.")))
    seen = F.transform(F.slice(summary["assertion_messages"], 1, 2), lambda m: strip(F.regexp_replace(m, r"^Assertion(?:Error)?:?\s*", "")))
    observed = F.array_join(F.transform(F.filter(seen, lambda m: (m != "") & (F.length(m) < 200)), lambda m: F.concat(F.lit("Observed: "), m)), " ")
    again = F.when(F.size(affected) > 0, F.concat(F.lit("This can be reproduced through tests in "), _listed(affected, 3), F.lit(".")))
    third = _some(full, through, exact, observed, again)
    return F.when(third == "", second).otherwise(third)


def word_entropy(text: Column) -> Column:
    """Shannon entropy in bits of the lower-cased words of a short text; 0 for one word or none."""
    words = tokens(F.lower(text))
    n = F.size(words)
    terms = F.transform(F.array_distinct(words), lambda x: F.size(F.filter(words, lambda y: y == x)) / n)
    return F.when(n <= 1, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def text_metrics(text: Column, patch: Column, files: Column) -> Column:
    """A struct of entropy, richness, density of a patch's identifiers, words and signal of a chain's paths (array); 3 decimals."""
    return F.struct(
        F.round(word_entropy(text), 3).alias("h_ps"),
        F.round(type_token_ratio(text), 3).alias("vocab_richness"),
        F.round(F.when(F.coalesce(patch, F.lit("")) != "", identifier_density(text, identifiers(patch, list(KEYWORDS)))).otherwise(0.0), 3).alias("identifier_density"),
        F.size(tokens(text)).alias("token_count"),
        F.round(chain_signals(text, files)["ratio"], 3).alias("chain_signal_ratio"),
    )


def _clean_sentences(text: Column) -> Column:
    none = F.array().cast("array<string>")
    kept = F.filter(F.transform(sentences(strip(text)), strip), lambda s: (s != "") & ~names.gives_away(s))
    return F.when(F.coalesce(text, F.lit("")).isin(*EMPTY_TEXTS), none).otherwise(kept)


def _symptom(message: Column) -> Column:
    """What an assertion message shows, or an empty text if that is too short."""
    m = strip(F.regexp_replace(message, r"^Assertion(?:Error)?:?\s*", ""))
    return F.when(F.length(m) < 5, "").when(F.length(m) > 200, F.concat(F.substring(m, 1, 200), F.lit("..."))).otherwise(m)


def _covered(new: Column, parts: Column) -> Column:
    return F.exists(parts, lambda p: F.lower(p).contains(F.substring(F.lower(new), 1, 60)))


def _place(repo: Column) -> Column:
    return F.when(F.coalesce(repo, F.lit("")) == "", "the project").otherwise(repo)


def from_output(parsed: Column, level: str, repo: Column) -> Column:
    """A problem text from test output alone (logs.parsed_output) at the level minimal, standard or detailed."""
    modules, traces = parsed["test_modules"], parsed["tracebacks"]
    if level == "minimal":
        failing = F.concat((parsed["total_failures"] + parsed["total_errors"]).cast("string"), F.lit(" test(s) in "), F.get(modules, 0), F.lit(" are failing."))
        return F.when(F.size(modules) > 0, failing).otherwise(F.concat(F.lit("Some tests in "), _place(repo), F.lit(" are failing.")))
    seen = F.transform(F.filter(F.transform(F.slice(parsed["assertion_messages"], 1, 3), _symptom), lambda s: s != ""), lambda s: F.concat(F.lit("Observed: "), s))
    raised = F.when(F.size(traces) > 0, F.array(F.concat(F.lit("The operation raises: "), F.get(traces, 0)["exception"]))).otherwise(F.array().cast("array<string>"))
    tests = F.transform(F.slice(parsed["failing_tests"], 1, 3), lambda t: F.when(t["description"] != "", F.concat(F.lit("Test "), t["method"], F.lit(" ("), t["class"], F.lit("): "), t["description"])).otherwise(F.concat(F.lit("Test "), t["method"], F.lit(" in "), t["class"], F.lit(" fails."))))
    parts = F.concat(seen, raised)
    parts = F.when(F.size(parts) > 0, parts).otherwise(tests)
    if level == "detailed":
        full = F.get(traces, 0)["full"]
        block = F.concat(F.lit("```\n"), F.when(F.length(full) > 500, F.concat(F.substring(full, 1, 500), F.lit("\n..."))).otherwise(full), F.lit("\n```"))
        parts = F.when(F.size(traces) > 0, F.concat(parts, F.array(block))).otherwise(parts)
    joined = F.array_join(parts, "\n\n" if level == "detailed" else " ")
    return F.when(F.size(parts) == 0, F.concat(F.lit("Tests in "), _place(repo), F.lit(" are failing unexpectedly."))).otherwise(joined)


def hybrid_text(text: Column, parsed: Column, level: str, repo: Column, mode: str = "hybrid") -> Column:
    """A problem text from a given one and test output; mode: llm_only, test_only, hybrid or test_enhanced (others count as hybrid)."""
    if mode == "llm_only":
        return text
    if mode == "test_only":
        return bound(parsed, lambda parsed: from_output(parsed, level, repo))
    clean = bound(text, _clean_sentences)
    return bound(parsed, lambda parsed: bound(clean, lambda clean: _hybrid(clean, from_output(parsed, level, repo), parsed, level, mode)))


def _hybrid(clean: Column, output: Column, parsed: Column, level: str, mode: str) -> Column:
    if mode == "test_enhanced":
        told = lambda output, new: F.when(F.size(new) > 0, strip(F.concat(F.array_join(new, " "), F.lit(" "), output))).otherwise(output)
        return bound(output, lambda output: bound(F.slice(F.filter(clean, lambda s: ~_covered(s, F.array(output))), 1, 2), lambda new: told(output, new)))
    add = lambda parts, s, lead, wanted: F.when(wanted & (s != "") & ~_covered(s, parts), F.concat(parts, F.array(F.concat(F.lit(lead), s)))).otherwise(parts)
    parts = F.aggregate(F.transform(F.slice(parsed["assertion_messages"], 1, 2), _symptom), clean, lambda p, s: add(p, s, "Observed: ", F.lit(True)))
    raised = F.coalesce(F.get(parsed["tracebacks"], 0)["exception"], F.lit(""))
    parts = bound(parts, lambda p: add(p, raised, "The operation raises: ", ~raised.contains("AssertionError")))
    return bound(parts, lambda p: _joined(p, output, level))


def _joined(parts: Column, output: Column, level: str) -> Column:
    if level == "minimal":
        first = F.get(parts, 0)
        made = F.when(F.size(tokens(first)) > 30, F.concat(F.array_join(F.slice(tokens(first), 1, 30), " "), F.lit("."))).otherwise(first)
    elif level == "standard":
        made = bound(F.array_join(parts, " "), lambda whole: F.when(F.size(tokens(whole)) > 120, F.concat(F.array_join(F.slice(tokens(whole), 1, 100), " "), F.lit("."))).otherwise(whole))
    else:
        made = F.array_join(parts, "\n\n")
    return F.when(F.size(parts) == 0, output).otherwise(made)


def informed_text(amount: Column, text: Column, parsed: Column, repo: Column) -> Column:
    """A struct of a problem text with an amount of information from 0 to 1, the components it tells, its words and how many were aimed at."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), amount))
    return bound(parsed, lambda parsed: bound(x, lambda x: _informed(x, text, parsed, repo)))


def _informed(x: Column, text: Column, parsed: Column, repo: Column) -> Column:
    modules, traces, kinds = parsed["test_modules"], parsed["tracebacks"], parsed["exception_types"]
    failing = F.concat((parsed["total_failures"] + parsed["total_errors"]).cast("string"), F.lit(" test(s) in "), F.get(modules, 0), F.lit(" are failing."))
    telling = F.slice(F.filter(_clean_sentences(text), lambda s: reduce(lambda a, b: a | b, [F.lower(s).contains(w) for w in BEHAVIOURS])), 1, 2)
    symptom = _symptom(F.get(parsed["assertion_messages"], 0))
    files = F.transform(F.slice(parsed["source_files"], 1, 3), lambda f: F.substring_index(f, "/", -1))
    full = F.get(traces, 0)["full"]
    made = {
        "affected_area": F.when(F.size(modules) > 0, failing).otherwise(F.concat(F.lit("Tests in "), _place(repo), F.lit(" are failing."))),
        "symptom_category": F.when(F.size(kinds) > 0, _worded(F.get(kinds, 0), CATEGORY_WORDS, F.concat(F.lit("The operation raises a "), F.get(kinds, 0), F.lit(".")))),
        "behavioral_desc": F.array_join(telling, " "),
        "concrete_example": F.when(symptom != "", F.concat(F.lit("Observed: "), symptom)),
        "exception_info": F.when(F.size(traces) > 0, F.concat(F.lit("Error: "), F.get(traces, 0)["exception"])),
        "source_hint": F.when(F.size(files) > 0, F.concat(F.lit("Affected files: "), F.array_join(files, ", "), F.lit("."))),
        "traceback": F.when(F.size(traces) > 0, F.concat(F.lit("Traceback:\n"), F.when(F.length(full) > 400, F.concat(F.substring(full, 1, 400), F.lit("\n..."))).otherwise(full))),
    }
    parts = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), F.when(x >= least, made[k]).alias("text")) for k, least in COMPONENTS]), lambda p: p["text"].isNotNull() & (p["text"] != ""))
    return bound(parts, lambda parts: _cut(x, parts))


def _cut(x: Column, parts: Column) -> Column:
    aim = (10 + x * 200).cast("int")
    short = lambda joined, words: F.when(F.size(words) > aim * 1.5, F.concat(F.array_join(F.slice(words, 1, aim), " "), F.lit("."))).otherwise(joined)
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), " ")
    made = bound(joined, lambda joined: bound(tokens(joined), lambda words: short(joined, words)))
    return bound(made, lambda cut: _told(cut, x, parts, aim))


def _told(cut: Column, x: Column, parts: Column, aim: Column) -> Column:
    return F.struct(cut.alias("problem_statement"), F.round(x, 2).alias("info_level"), F.transform(parts, lambda p: p["name"]).alias("components"), F.size(tokens(cut)).alias("token_count"), aim.alias("target_tokens"))

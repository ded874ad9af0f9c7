"""Ids, paths, labels and verdict texts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a log holds when code does not even load, and the kind of that crash, in order of precedence.
CRASHES = (
    ("ImportError:", "import_error"),
    ("ModuleNotFoundError:", "module_not_found"),
    ("SyntaxError:", "syntax_error"),
    ("IndentationError:", "indentation_error"),
    ("AttributeError: module", "module_attribute_error"),
    ("NameError:", "name_error"),
    ("TypeError: 'NoneType'", "none_type_error"),
)
#: Sentences that give a repair away.
GIVEAWAYS = (
    r"(?i)\b(fix|replace|change|switch)\b.*\b(to|from|with)\b",
    r"(?i)\bshould\s+(?:use|be|have|call|return|raise)\b",
    r"(?i)\b(needs to be|must be|has to be)\b",
    r"(?i)\bthe\s+(bug|issue|root cause|problem)\s+is\b",
    r"(?i)\binstead of\s+(?:using|calling)\b",
    r"(?i)\b(?:missing|removed|deleted|added)\s+(?:the\s+)?(?:call|check|import)\b",
)
#: File names that tell nothing, and folders that tell nothing either.
DULL_STEMS = ("__init__", "utils", "base", "models", "views", "tests")
DULL_FOLDERS = ("src", "lib", "django", "tests", "__pycache__")


def crash(before: Column, after: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """The kind of crash that only the second log shows, or null; extra: further signs of a repository, after the common ones."""
    signs = (*CRASHES, *extra)
    clean = ~reduce(lambda a, b: a | b, [F.coalesce(before, F.lit("")).contains(sign) for sign, _ in signs])
    return F.when(clean, F.coalesce(*[F.when(after.contains(sign), F.lit(kind)) for sign, kind in signs]))


def gives_away(sentence: Column) -> Column:
    return reduce(lambda a, b: a | b, [sentence.rlike(p) for p in GIVEAWAYS])


def repo_of(instance: Column) -> Column:
    """owner/name of an id owner__name-number; the id itself without two underscores."""
    owner, rest = F.split(instance, "__")[0], F.get(F.split(instance, "__"), F.lit(1))
    return F.when(rest.isNull(), instance).otherwise(F.concat(owner, F.lit("/"), F.regexp_replace(rest, r"-[^-]*$", "")))


def image_of(prefix: str, instance: Column) -> Column:
    """The lower-case image name, double underscores written as _1776_."""
    return F.concat(F.lit(prefix), F.lower(F.replace(instance, F.lit("__"), F.lit("_1776_"))))


def module_of(path: Column) -> Column:
    """The file's stem, or the nearest telling folder if the stem tells nothing."""
    parts = F.split(F.regexp_replace(F.replace(path, F.lit("."), F.lit("/")), "/py$", ""), "/")
    stem = F.element_at(parts, -1)
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: (x != "") & ~x.isin(*DULL_FOLDERS))
    return F.when(stem.isin(*DULL_STEMS) & (F.size(folders) > 0), F.try_element_at(folders, F.lit(-1))).otherwise(stem)


def node_function(node: Column) -> Column:
    """What follows the last dot after the last colon; empty without a colon."""
    return F.when(node.contains(":"), F.substring_index(F.substring_index(node, ":", -1), ".", -1)).otherwise("")


def node_class(node: Column) -> Column:
    """The capitalised name before a dot after the last colon, or empty."""
    return F.regexp_extract(F.when(node.contains(":"), F.substring_index(node, ":", -1)).otherwise(""), r"^([A-Z][^.]*)\.", 1)


def same_file(guess: Column, actual: Column) -> Column:
    """Equal paths or equal file names; an empty guess, or one that says it cannot tell, never matches."""
    a, b = F.regexp_replace(F.trim(guess), "^/+|/+$", ""), F.regexp_replace(F.trim(actual), "^/+|/+$", "")
    known = (F.length(guess) > 0) & (F.length(actual) > 0) & ~F.lower(guess).contains("cannot_determine")
    return F.coalesce(known & (F.substring_index(a, "/", -1) == F.substring_index(b, "/", -1)), F.lit(False))


#: Kinds of repair and the words that stand for them.
KIND_WORDS = {
    "condition refinement": ("condition", "if statement", "guard", "check", "boolean"),
    "argument update": ("argument", "parameter", "function call", "passing"),
    "statement insertion": ("add", "insert", "missing", "new line"),
    "constant update": ("constant", "value", "literal", "number", "string"),
    "type cast": ("type", "cast", "convert", "coerce"),
    "guard clause": ("guard", "check", "validation", "early return"),
    "var replace": ("variable", "rename", "replace", "swap"),
    "return value": ("return", "output", "result"),
}


def same_kind(guess: Column, actual: Column) -> Column:
    """Does a guessed kind of repair mean the actual one: does either name hold the other, or the guess a word for it? A guess that cannot tell never does."""
    plain = lambda c: F.translate(F.lower(F.trim(c)), "_-", "  ")
    g, a = plain(guess), plain(actual)
    known = (F.length(guess) > 0) & (F.length(actual) > 0) & ~F.lower(guess).contains("cannot_determine")
    worded = reduce(lambda x, y: x | y, [a.contains(k) & reduce(lambda x, y: x | y, [g.contains(w) for w in ws]) for k, ws in KIND_WORDS.items()])
    return F.coalesce(known & (g.contains(a) | a.contains(g) | worded), F.lit(False))


def leak_score(file_match: Column, type_match: Column, confidence: Column) -> Column:
    """0.35 for each match, and 0.30 or 0.15 for high or middling confidence; 1 at most."""
    base = F.when(file_match, 0.35).otherwise(0.0) + F.when(type_match, 0.35).otherwise(0.0)
    return F.least(F.lit(1.0), base + F.when(confidence > 0.7, 0.3).when(confidence > 0.4, 0.15).otherwise(0.0))

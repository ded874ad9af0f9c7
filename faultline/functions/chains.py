"""Chains of nodes from a symptom to its root cause: alignment with seeds and with tracebacks, and what may be told of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names
from .scalars import bound


def file_of(node_id: Column, path: Column | None = None) -> Column:
    """The given path, else the part of the id before a colon, else the id if it is a Python file; empty if there is none."""
    own = F.when(node_id.contains(":"), F.substring_index(node_id, ":", 1)).when(node_id.endswith(".py"), node_id).otherwise("")
    return own if path is None else F.when(F.coalesce(path, F.lit("")) != "", path).otherwise(own)


def semantic_alignment(seed_id: Column, seed_file: Column, other_id: Column, other_file: Column) -> Column:
    """How alike the places of two root causes are, from 0.4 to 1: shared folders from the top, the same file name, the same beginning of the name."""
    folders = lambda f: F.slice(F.split(f, "/"), 1, F.size(F.split(f, "/")) - 1)
    a, b = folders(seed_file), folders(other_file)
    n = F.least(F.size(a), F.size(b))
    apart = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), F.lit(False))
    common = F.when(apart > 0, apart - 1).otherwise(n)
    both = (F.coalesce(seed_file, F.lit("")) != "") & (F.coalesce(other_file, F.lit("")) != "")
    base = F.when(~both, 0.5).when(common >= 2, 0.9).when(common >= 1, 0.7).otherwise(0.4)
    last = lambda f: F.element_at(F.split(f, "/"), -1)
    base = F.when(both & (last(seed_file) == last(other_file)), F.least(base + 0.1, F.lit(1.0))).otherwise(base)

    def start(node: Column) -> Column:
        name = F.when(node.contains(":"), F.substring_index(node, ":", -1)).otherwise("")
        return F.when(name.contains("_"), F.substring_index(name, "_", 1)).otherwise(F.substring(name, 1, 4))

    named = (F.coalesce(seed_id, F.lit("")) != "") & (F.coalesce(other_id, F.lit("")) != "")
    return F.when(named & (start(seed_id) == start(other_id)), F.least(base + 0.05, F.lit(1.0))).otherwise(base)


def chain_alignment(seed: Column, other: Column) -> Column:
    """A struct of how well a chain follows its seed; both are arrays of struct<node_id, node_type, file_path>.

    depth_match: of the lengths; structure: equal types by position; semantic: of the last nodes, 0 if a chain is empty; overall: 0.4, 0.4 and 0.2 of them.
    """
    n, m = F.size(seed), F.size(other)
    top = F.greatest(n, m)
    depth = F.when(top > 0, 1 - F.abs(n - m) / top).otherwise(0.0)
    short = F.least(n, m)
    same = F.size(F.filter(F.zip_with(F.slice(seed, 1, short), F.slice(other, 1, short), lambda a, b: a["node_type"] == b["node_type"]), lambda x: x))
    structure = F.when(top > 0, same / top).otherwise(0.0)
    a, b = F.try_element_at(seed, F.lit(-1)), F.try_element_at(other, F.lit(-1))
    semantic = F.when(short == 0, 0.0).otherwise(semantic_alignment(a["node_id"], file_of(a["node_id"], a["file_path"]), b["node_id"], file_of(b["node_id"], b["file_path"])))
    return F.struct(depth.alias("depth_match"), structure.alias("structure"), semantic.alias("semantic"), (0.4 * depth + 0.4 * structure + 0.2 * semantic).alias("overall"))


def normalized_chain(text: Column) -> Column:
    """Node ids of a chain given as JSON text: a list of texts or of objects with node_id, id or name, an object with such a list under nodes, or a bare id."""
    t = F.trim(text)
    inner = F.when(t.startswith("{"), F.get_json_object(t, "$.nodes")).otherwise(t)
    items = F.from_json(inner, "array<string>")
    pick = lambda x: F.when(x.startswith("{"), F.coalesce(F.nullif(F.get_json_object(x, "$.node_id"), F.lit("")), F.nullif(F.get_json_object(x, "$.id"), F.lit("")), F.get_json_object(x, "$.name"))).otherwise(x)
    listed = F.filter(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.trim(pick(x))), lambda x: x.isNotNull() & (x != ""))
    none = F.array().cast("array<string>")
    quoted = F.regexp_extract(t, r'^"(.*)"$', 1)
    bare = F.when(quoted != "", F.array(quoted)).otherwise(F.array(t))
    return F.when(F.coalesce(t, F.lit("")) == "", none).when(F.coalesce(inner, F.lit("")).startswith("["), F.coalesce(listed, bare)).when(t.startswith("{"), none).otherwise(bare)


def positional_types(nodes: Column) -> Column:
    """An array of node ids with types by place: the first is the symptom, the last the root cause, one alone the symptom."""
    return F.transform(nodes, lambda x, i: F.struct(x.alias("node_id"), F.when(i == 0, "symptom").when(i == F.size(nodes) - 1, "root_cause").otherwise("intermediate").alias("node_type"), file_of(x).alias("file_path")))


def structured_chain(text: Column, seed_length: Column) -> Column:
    """A chain written with commas or arrows, cut to one more than the longer of two and its seed's length, with positional types."""
    ids = F.filter(F.transform(F.split(text, r"\s*(?:,|->|→)\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return positional_types(F.slice(ids, 1, F.greatest(seed_length, F.lit(2)) + 1))


def hints(node: Column) -> Column:
    """A struct of the file and the function that a node id hints at; empty where it does not."""
    left, right = F.substring_index(node, ":", 1), F.regexp_replace(node, "^[^:]*:", "")
    colon, slash = node.contains(":"), node.contains("/") & node.endswith(".py")
    file = F.when(colon & (left.endswith(".py") | left.contains("/")), left).when(~colon & slash, node).otherwise("")
    func = F.when(colon, F.substring_index(right, ":", -1)).when(slash, "").otherwise(F.substring_index(node, ".", -1))
    return F.struct(file.alias("file"), func.alias("func"))


def trace_alignment(proposed: Column, target: Column, traces: Column) -> Column:
    """A struct of how well failing tests run through a proposed chain.

    proposed: an array of node ids; target: the node that must be hit, appended if it is missing, none if empty; traces: an array with an array of
    struct<file_path, function, code> for each failing test. The test with the best coverage, then the best order, decides;
    the target is hit if any test hits it.
    """
    goal = F.trim(F.coalesce(target, F.lit("")))
    given = F.coalesce(proposed, F.array().cast("array<string>"))
    whole = lambda goal, given: F.when((goal != "") & ~F.array_contains(given, goal), F.concat(given, F.array(goal))).otherwise(given)
    hinted = lambda chain: F.transform(chain, lambda n: F.struct(n.alias("n"), hints(n).alias("h")))
    return bound(goal, lambda goal: bound(bound(given, lambda g: hinted(whole(goal, g))), lambda chain: bound(traces, lambda given: _trace_alignment(chain, goal, given))))


def _judged(chain: Column, frames: Column) -> Column:
    """Coverage, ordering and matched nodes of one test; chain: array<struct<n, h>> of nodes and their hints."""
    texts = F.transform(frames, lambda f: F.concat_ws(" ", F.coalesce(f["file_path"], F.lit("")), F.coalesce(f["function"], F.lit("")), F.coalesce(f["code"], F.lit(""))))

    def place(h: Column, texts: Column) -> Column:
        hit = F.transform(texts, lambda t: ((h["file"] != "") & t.contains(h["file"])) | ((h["func"] != "") & t.contains(h["func"])))
        return F.array_position(hit, F.lit(True))

    def measured(places: Column) -> Column:
        matched, order = F.array_distinct(F.transform(places, lambda x: x["n"])), F.transform(places, lambda x: x["p"])
        return bound(order, lambda order: bound(matched, lambda matched: judge(order, matched)))

    def judge(order: Column, matched: Column) -> Column:
        k = F.size(order)
        wrong = F.aggregate(F.transform(order, lambda x, i: F.size(F.filter(F.slice(order, i + 2, k), lambda y: y < x))), F.lit(0), lambda s, v: s + v)
        ordering = F.when(F.size(matched) < 2, 0.0).otherwise(1 - wrong / (k * (k - 1) / 2))
        return F.struct((F.size(matched) / F.size(chain)).alias("coverage"), ordering.alias("ordering"), matched.alias("matched"))

    places = bound(texts, lambda texts: F.filter(F.transform(chain, lambda c: F.struct(c["n"].alias("n"), place(c["h"], texts).alias("p"))), lambda x: x["p"] > 0))
    return bound(places, measured)


def _trace_alignment(chain: Column, goal: Column, traces: Column) -> Column:
    total = F.size(chain)
    row = lambda c, m, h, o, s: F.struct(F.round(c, 4).alias("trace_coverage"), m.alias("matched_nodes"), total.alias("total_nodes"), h.alias("target_hit"), F.round(o, 4).alias("causal_ordering"), F.round(s, 4).alias("overall"))
    zero = F.lit(0.0)
    nothing = row(zero, F.array().cast("array<string>"), F.lit(False), zero, zero)

    def summed(judged: Column) -> Column:
        best = F.array_max(F.transform(judged, lambda j: F.struct(j["coverage"].alias("coverage"), j["ordering"].alias("ordering"))))
        matched = F.array_sort(F.array_distinct(F.flatten(F.transform(judged, lambda j: j["matched"]))))
        return bound(best, lambda best: bound(matched, lambda matched: result(best, matched)))

    def result(best: Column, matched: Column) -> Column:
        hit = (goal != "") & F.array_contains(matched, goal)
        coverage, ordering = F.coalesce(best["coverage"], F.lit(0.0)), F.coalesce(best["ordering"], F.lit(0.0))
        return row(coverage, matched, hit, ordering, 0.5 * coverage + 0.25 * hit.cast("int") + 0.25 * ordering)

    judged = F.transform(F.filter(traces, lambda t: F.size(t) > 0), lambda frames: _judged(chain, frames))
    return F.when((total == 0) | (F.size(F.coalesce(traces, F.array())) <= 0), nothing).otherwise(bound(judged, summed))


def admission(status: Column, coverage: Column, target_hit: Column, least: float, need_target: bool, enforce: bool) -> Column:
    """A struct of the status after a look at the chain's coverage, why a valid defect would be refused (null if not), and whether that was only noted."""
    why = F.when(coverage < least, F.format_string(f"Chain coverage too low: %.2f < {least:.2f}", coverage))
    if need_target:
        why = why.when(~target_hit, "Target node not observed in failing traceback")
    why = F.when(status == "valid", why)
    return F.struct((F.when(why.isNotNull(), "invalid").otherwise(status) if enforce else status).alias("status"), why.alias("reason"), (why.isNotNull() & F.lit(not enforce)).alias("shadow"))


def exposed(chain: Column, level: str) -> Column:
    """A struct of what a problem text may tell of a chain (array of struct<node_id, node_type, file_path>) at level L1, L2 or L3.

    modules, functions and classes, sorted: of symptoms; from L2 on of intermediate nodes; at L3 also the module and function of root causes.
    forbidden: the full ids of root causes.
    """
    of = lambda *types: F.filter(chain, lambda n: F.lower(n["node_type"]).isin(*types))
    told = of("symptom") if level == "L1" else of("symptom", "intermediate")
    named = F.concat(told, of("root_cause")) if level == "L3" else told
    clean = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))))
    return F.struct(
        clean(F.transform(F.filter(named, lambda n: F.coalesce(n["file_path"], F.lit("")) != ""), lambda n: names.module_of(n["file_path"]))).alias("modules"),
        clean(F.transform(named, lambda n: names.node_function(n["node_id"]))).alias("functions"),
        clean(F.transform(told, lambda n: names.node_class(n["node_id"]))).alias("classes"),
        clean(F.filter(F.transform(of("root_cause"), lambda n: n["node_id"]), lambda x: x.contains(":"))).alias("forbidden"),
    )

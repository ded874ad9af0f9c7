"""Mixing sources: temperature weights, realised as budgeted block permutations.

A source with the share p of all tokens gets a weight in proportion to p ** a. The exponent a
in [0, 1] (1: as found, 0: all alike) is found by bisection: the smallest that holds the most
repeated source to at most `max_repeats` passes, and whose weights have at most
`target_entropy` nats if that is given. Five halvings are taken at once: each pass over the
stored source totals evaluates 31 exponents in one aggregation.

The budget is in tokens; by default it is the least that uses every source at least once, so no
document is left out. A source's quota is its weight times the budget. It is drawn in passes
(epochs): each pass orders the source's documents by blocks, the blocks by a hash of the block
and pass, the documents in a block by a hash of the document and pass. All whole passes are
taken, and of the last one the documents that begin before the rest of the quota is used up.

A document is hashed by its id and text together. Where the last pass ends is found from a stored table without texts:
first the block in which it ends, by running sums of block sizes (at most 16 ** block_digits rows a source), then
the document, by running sums in that one block. What a row is drawn for follows from its own two hashes and
its source's end, so texts are never shuffled, and a source with a third of all rows is never in one task.

Defined results:
- null source: a source of its own; null or empty text: no tokens, so such a row is drawn once in every whole pass;
- null ids: such rows are told apart by their texts; rows that repeat both id and text are drawn equally often, all in the
  last pass or none;
- an empty table, or no tokens at all: an empty mixture, or each row once;
- other columns are ignored by mix_sources and carried along by mix_rows, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, stored, words_of

MAX_REPEATS, HALVINGS = 2.0, 40
#: A block is named by so many leading hexadecimal digits of a hash.
BLOCK_DIGITS = 4


def exponent(totals: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, halvings: int = HALVINGS) -> float:
    """The bisected exponent for the stored totals (one row a source, its tokens in `total`); see the module.

    Entropy grows and repetition shrinks as the exponent falls and rises; if the limits contradict each other,
    the exponent that the repetition limit asks for is returned.
    """
    points = totals.where("total > 0").select(F.ln(F.col("total").cast("double")).alias("l"))
    top, low = points.agg(F.max("l"), F.min("l")).first()
    if top is None:
        return 1.0
    # shares are taken against the largest source: a common factor changes neither limit
    rel = F.col("l") - F.lit(top)

    def meets(grid: list[float]) -> list[bool]:
        cols = [c for a in grid for e in [F.exp(rel * F.lit(a))] for c in (F.sum(e), F.sum(e * rel))]
        sums = points.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        entropies = [math.log(z) - a * zl / z for a, z, zl in zip(grid, sums[::2], sums[1::2], strict=True)]
        return [math.exp((top - low) * (1 - a)) <= max_repeats and (target_entropy is None or h <= target_entropy) for a, h in zip(grid, entropies, strict=True)]

    if meets([0.0])[0]:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(0, halvings, 5):
        good = [*meets([lo + (hi - lo) * k / 32 for k in range(1, 32)]), True]
        k = good.index(True) + 1
        lo, hi = lo + (hi - lo) * (k - 1) / 32, lo + (hi - lo) * k / 32
    return hi


def _with(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """rows with the plan of their source; plan has n rows, which are broadcast if they are few enough."""
    plan = plan.withColumnRenamed("source", "of_source")
    return rows.join(F.broadcast(plan) if n <= BROADCAST_IDS else plan, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def _hashes(epoch: Column, digits: int) -> tuple[Column, Column]:
    """The order of a row's block in a pass, and that of the row in its block; a row's own hash is `key`."""
    block = F.md5(F.concat_ws("|", F.lit("block"), epoch, F.substring("key", 1, digits)))
    return block, F.md5(F.concat_ws("|", F.lit("row"), epoch, "key"))


def _keyed(row: Column, doc_id: Column, source: Column, text: Column) -> list[Column]:
    """row, source, tokens and key: the columns that draws are made from."""
    text = text.cast("string")
    key = F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return [row.alias("row"), source.alias("source"), F.size(words_of(text)).cast("long").alias("tokens"), key.alias("key")]


def draw_plan(rows: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget_tokens: int | None = None, block_digits: int = BLOCK_DIGITS) -> tuple[DataFrame, int]:
    """A stored row for each source: source, full (whole passes) and where the last pass ends: end_block, end_row; and their number.

    rows: a stored table of source, tokens and key.
    """
    totals = stored(rows.groupBy("source").agg(F.sum("tokens").alias("total")))
    n = totals.count()
    a = exponent(totals, max_repeats, target_entropy)
    most, top = totals.agg(F.max("total"), F.max(F.ln(F.col("total").cast("double")))).first()
    repeats = F.when(F.col("total") > 0, F.exp((F.lit(float(top or 0.0)) - F.ln(F.col("total").cast("double"))) * F.lit(1.0 - a))).otherwise(F.lit(1.0))
    least = totals.agg(F.sum(F.round(repeats * F.col("total")))).first()[0]
    scale = 1.0 if budget_tokens is None or not least else budget_tokens / float(least)
    quota = F.round(repeats * F.col("total") * F.lit(scale)).cast("long")
    passes = totals.withColumn("quota", quota).select("source", F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(1).cast("long").alias("full"), F.when(F.col("total") > 0, F.pmod("quota", "total")).otherwise(0).cast("long").alias("rest"))
    passes = stored(passes)
    block, order = _hashes(F.col("full"), block_digits)
    begun = _with(rows, passes.where("rest > 0"), n).select("source", "rest", "tokens", block.alias("block"), order.alias("order"))
    before = lambda by: F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = begun.groupBy("source", "rest", "block").agg(F.sum("tokens").alias("tokens")).withColumn("before", before("block"))
    ends = stored(sizes.where("before < rest and before + tokens >= rest").select("source", F.col("block").alias("end_block"), (F.col("rest") - F.col("before")).alias("left")))
    last = _with(begun, ends, n).where("block = end_block").groupBy("source", "end_block", "left", "order").agg(F.sum("tokens").alias("tokens")).withColumn("before", before("order"))
    last = last.where("before < left").groupBy("source", "end_block").agg(F.max("order").alias("end_row"))
    return stored(_with(passes.select("source", "full"), last, n).select("source", "full", "end_block", "end_row").unionByName(passes.where("rest = 0").select("source", "full", F.lit("").alias("end_block"), F.lit("").alias("end_row")))), n


def _drawn(rows: DataFrame, plan: DataFrame, n: int, digits: int) -> DataFrame:
    """rows(row, source, tokens, key) as often as the plan draws them, with epoch, block_key and row_key."""
    block, order = _hashes(F.col("full"), digits)
    marked = _with(rows, plan, n).withColumns({"block": block, "order": order})
    more = F.when((F.col("block") < F.col("end_block")) | ((F.col("block") == F.col("end_block")) & (F.col("order") <= F.col("end_row"))), 1).otherwise(0)
    times = marked.withColumn("times", F.col("full") + more).where("times > 0")
    each = times.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    block, order = _hashes(F.col("epoch"), digits)
    return each.select("row", "source", "tokens", "epoch", block.alias("block_key"), order.alias("row_key"))


def mix_rows(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_digits: int = BLOCK_DIGITS, **limits) -> DataFrame:
    """One row for each draw: `row` (a struct of all columns of rows), source, tokens, epoch, block_key, row_key.

    Within a source the drawn stream is sorted by the last three. limits: see draw_plan.
    """
    columns = [F.col(id_col), F.col(source_col), F.col(text_col)]
    narrow = stored(rows.select(*_keyed(F.lit(None).cast("int"), *columns)))
    plan, n = draw_plan(narrow, block_digits=block_digits, **limits)
    return _drawn(rows.select(*_keyed(F.struct("*"), *columns)), plan, n, block_digits)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_digits: int = BLOCK_DIGITS, **limits) -> DataFrame:
    """One row for each time a document is drawn: doc_id, source, n_tokens, epoch, block_key, row_key. limits: see draw_plan."""
    narrow = stored(docs.select(*_keyed(F.col(id_col), F.col(id_col), F.col(source_col), F.col(text_col))))
    plan, n = draw_plan(narrow, block_digits=block_digits, **limits)
    return _drawn(narrow, plan, n, block_digits).select(F.col("row").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "epoch", "block_key", "row_key")

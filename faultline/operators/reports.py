"""Summaries of runs: statuses, evaluations, usage, leaks, traces and coverage; and the order in which work is done."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rates for a million tokens of models without a rate of their own.
DEFAULT_INPUT, DEFAULT_OUTPUT = 0.574, 2.294
#: Names that a price list may hold; it is broadcast, and every model looks for them.
MOST_RATES = 10_000


def validation_summary(results: DataFrame) -> DataFrame:
    """repo, status, n, valid_bugs: by both, by each and in all (null: any); results: repo, status, is_valid_bug."""
    sets = results.groupingSets([["repo", "status"], ["repo"], ["status"], []], "repo", "status")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid_bug").alias("valid_bugs"))


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """total, submitted, resolved, errors and the rate as text by model and level; an error no_submission is none."""
    out = rows.groupBy("model", "level").agg(F.count(F.lit(1)).alias("total"), F.count_if("submitted").alias("submitted"), F.count_if("resolved").alias("resolved"), F.count_if(F.col("error").isNotNull() & (F.col("error") != "no_submission")).alias("errors"))
    return out.withColumn("resolve_rate", F.format_string("%d/%d (%.1f%%)", "resolved", "total", 100 * F.col("resolved") / F.col("total")))


def usage_costs(records: DataFrame, rates: DataFrame) -> DataFrame:
    """calls, tokens and cost by model (in lower case) and in all (null), each record once.

    records: model, input_tokens, output_tokens, cache_write, cache_read, timestamp; two are one if they share model, tokens and timestamp.
    rates: ord, name, input, cache_write, cache_read, output for a million tokens, a small table: the first whose name the model holds
    is used, else the default without caches.
    """
    keys = ["model", "input_tokens", "output_tokens", "timestamp"]
    once = records.groupBy(*keys).agg(F.min(F.struct("cache_write", "cache_read")).alias("c")).select(*keys, "c.*").withColumn("model", F.lower("model"))
    models = once.select("model").distinct()
    if rates.limit(MOST_RATES + 1).count() > MOST_RATES:
        raise ValueError(f"more than {MOST_RATES} rates are no price list")
    named = models.join(F.broadcast(rates), F.col("model").contains(F.col("name")))
    rate = named.groupBy("model").agg(F.min(F.struct("ord", "input", F.col("cache_write").alias("write"), F.col("cache_read").alias("read"), "output")).alias("r"))
    base = F.greatest(F.lit(0), F.col("input_tokens") - F.col("cache_write") - F.col("cache_read"))
    kinds = {"input": base, "write": F.col("cache_write"), "read": F.col("cache_read"), "output": F.col("output_tokens")}
    tokens = [F.sum(c.cast("decimal(20,0)")).alias(f"n_{k}") for k, c in kinds.items()]
    totals = [F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")]
    # whole tokens are summed, and each sum is multiplied by its rate once, in decimals: no order of adding changes the cost
    by_model = once.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), *totals, *tokens).join(rate, "model", "left")
    price = lambda k: F.col(f"r.{k}").cast("decimal(18,9)") * F.col(f"n_{k}")
    own = reduce(lambda x, y: x + y, [price(k) for k in kinds])
    other = F.lit(str(DEFAULT_INPUT)).cast("decimal(18,9)") * F.col("input_tokens").cast("decimal(20,0)") + F.lit(str(DEFAULT_OUTPUT)).cast("decimal(18,9)") * F.col("n_output")
    priced = by_model.withColumn("micro", F.when(F.col("r").isNull(), other).otherwise(own).cast("decimal(38,9)"))
    out = priced.rollup("model").agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("micro").alias("micro"))
    return out.select("model", "calls", "input_tokens", "output_tokens", F.round(F.col("micro") / F.lit(1_000_000), 6).cast("double").alias("cost"))


def leak_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, match rates, mean leak, how many above one half and how many of none; rows: file_match, type_match, leak."""
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("n"), F.round(F.count_if("file_match") / n, 6).alias("file_match_rate"), F.round(F.count_if("type_match") / n, 6).alias("type_match_rate"), F.round(F.avg("leak"), 6).alias("mean_leak"), F.count_if(F.col("leak") > 0.5).alias("high"), F.count_if(F.col("leak") == 0).alias("no_leak"))


def trace_summary(rows: DataFrame, root: str = "/testbed/") -> DataFrame:
    """One row: how many have a trace, hit their root, and share files on average; rows: designed, traced (arrays of paths), root. Paths lose the folder of the run."""
    plain = lambda c: F.array_distinct(F.transform(c, lambda x: F.regexp_replace(x, "^" + root, "")))
    each = rows.select(plain(F.col("designed")).alias("d"), plain(F.col("traced")).alias("t"), F.regexp_replace("root", "^" + root, "").alias("root"))
    overlap = F.size(F.array_intersect("d", "t")) / F.greatest(F.size("d"), F.lit(1))
    return each.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("t") > 0).alias("has_trace"), F.count_if(F.array_contains("t", F.col("root"))).alias("root_hits"), F.round(F.avg(overlap), 6).alias("mean_overlap"))


def coverage_report(bugs: DataFrame, n_seeds: int, by: list[str]) -> DataFrame:
    """seeds that have a defect, defects, defects a seed, and the share of all seeds; bugs: seed."""
    out = bugs.groupBy(*by).agg(F.count_distinct("seed").alias("seeds"), F.count(F.lit(1)).alias("bugs"))
    return out.withColumns({"per_seed": F.round(F.coalesce(F.try_divide("bugs", "seeds"), F.lit(0.0)), 6), "rate": F.round(F.coalesce(F.try_divide(F.col("seeds"), F.lit(n_seeds)), F.lit(0.0)), 6)})


def head_and_tail(rows: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """rows with side (head, tail) and rank: the k largest and the k smallest by value, ties by key; two limits, no window over all."""
    def side(name: str, order) -> DataFrame:
        best = rows.orderBy(order, key).limit(k)
        return best.withColumns({"side": F.lit(name), "rank": F.row_number().over(Window.orderBy(order, key))})  # k rows

    return side("head", F.desc(value)).unionByName(side("tail", F.asc(value)))


def chunks(rows: DataFrame, group: str, order: list[str], workers: int, least: int = 50, each: int = 30) -> DataFrame:
    """rows with chunk: groups of more than `least` rows are cut, in order, into as many equal chunks as there are workers or thirties of rows, two at least."""
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    splits = F.least(F.lit(workers), F.greatest(F.lit(2), F.floor(F.col("__n") / each)))
    size = n.select(group, F.when(F.col("__n") > least, F.greatest(F.ceil(F.col("__n") / splits), F.lit(1))).otherwise(F.col("__n")).alias("__size"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return rows.join(size, group).withColumn("chunk", F.floor(place / F.col("__size")).cast("long")).drop("__size")


def split_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows with state: done where their key is among the done ones, else pending."""
    marks = done.select(key).distinct().withColumn("__d", F.lit(True))
    return rows.join(marks, key, "left").withColumn("state", F.when(F.col("__d"), "done").otherwise("pending")).drop("__d")

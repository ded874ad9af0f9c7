"""Operators on tables of test runs, chains, usage and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASSES, FAILS = ("PASSED", "XFAIL", "SKIPPED"), ("FAILED", "ERROR")


def last_status(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The status that comes last for each key; a partial aggregate, no window."""
    return log.groupBy(*keys).agg(F.max_by("status", F.struct(*order)).alias("status"))


def transitions(runs: DataFrame) -> DataFrame:
    """(instance, test, pre, post, category) of tests that ran in both phases; runs: instance, test, phase, status."""
    by = runs.groupBy("instance", "test").agg(F.max(F.when(F.col("phase") == "pre", F.col("status"))).alias("pre"), F.max(F.when(F.col("phase") == "post", F.col("status"))).alias("post"))
    ok = lambda c: F.col(c).isin(*PASSES)
    bad = lambda c: F.col(c).isin(*FAILS)
    kind = F.when(bad("pre") & ok("post"), "FAIL_TO_PASS").when(ok("pre") & bad("post"), "PASS_TO_FAIL").when(ok("pre") & ok("post"), "PASS_TO_PASS").when(bad("pre") & bad("post"), "FAIL_TO_FAIL")
    return by.where("pre is not null and post is not null").withColumn("category", kind)


def verdicts(moved: DataFrame) -> DataFrame:
    """Counts of the four classes, the status and whether the instance is a valid defect."""
    n = lambda k: F.count_if(F.col("category") == k).alias(k.lower())
    out = moved.groupBy("instance").agg(*[n(k) for k in ("FAIL_TO_PASS", "PASS_TO_FAIL", "PASS_TO_PASS", "FAIL_TO_FAIL")])
    valid = (F.col("pass_to_fail") > 0) & (F.col("pass_to_pass") > 0)
    return out.withColumn("status", F.when(valid, "valid").otherwise("invalid")).withColumn("is_valid_bug", valid & (F.col("fail_to_fail") == 0) & (F.col("fail_to_pass") == 0))


def entropy(words: DataFrame, key: str, word: str) -> DataFrame:
    """Shannon entropy in bits of the words of each key: counts first, then one sum; 0 for one word."""
    counts = words.groupBy(key, word).agg(F.count(F.lit(1)).alias("n"))
    total, logs = F.sum("n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    return counts.groupBy(key).agg(F.when(total > 1, F.log2(total.cast("double")) - logs / total).otherwise(0.0).alias("entropy"))


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: __run numbers them within a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = (F.col(value) != F.lag(value).over(w)) | F.lag(value).over(w).isNull()
    return df.withColumn("__c", F.when(change, 1).otherwise(0)).withColumn("__run", F.sum("__c").over(w)).drop("__c")


def typed_by_position(chain: DataFrame, key: str, pos: str) -> DataFrame:
    """node_type by place: the last is root_cause, the first symptom, those between intermediate."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    k = F.row_number().over(Window.partitionBy(key).orderBy(pos))
    return chain.withColumn("node_type", F.when(k == n, "root_cause").when(k == 1, "symptom").otherwise("intermediate"))


def chain_alignment(seed: DataFrame, other: DataFrame) -> DataFrame:
    """Depth and type agreement of chains aligned by position; both have pair, pos, node_type."""
    a = seed.select("pair", "pos", F.col("node_type").alias("ta"))
    b = other.select("pair", "pos", F.col("node_type").alias("tb"))
    both = a.join(b, ["pair", "pos"], "full").groupBy("pair").agg(F.count("ta").alias("na"), F.count("tb").alias("nb"), F.count_if(F.col("ta") == F.col("tb")).alias("same"))
    top = F.greatest("na", "nb")
    depth, structure = 1 - F.abs(F.col("na") - F.col("nb")) / top, F.col("same") / top
    return both.select("pair", "na", "nb", "same", F.round(depth, 6).alias("depth_match"), F.round(structure, 6).alias("structure_similarity"), F.round(0.4 * depth + 0.4 * structure, 6).alias("partial_score"))

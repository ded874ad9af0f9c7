"""The table of a defect's quality, and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logs, scalars

#: Repositories whose short name is not the part after the slash.
SHORT_NAMES = {"scikit-learn/scikit-learn": "sklearn", "scikit-learn": "sklearn"}


def short_repo(repo: Column) -> Column:
    return F.coalesce(*[F.when(repo == k, F.lit(v)) for k, v in SHORT_NAMES.items()], F.substring_index(repo, "/", -1))


def stored_alignment(result: Column) -> Column:
    """The alignment of a validation result (JSON): of its structure if that is there, else overall, else 0."""
    get = lambda p: F.get_json_object(result, p).cast("double")
    return F.coalesce(get("$.chain_alignment_score.structural_alignment.overall_score"), get("$.chain_alignment_score.overall_score"), F.lit(0.0))


def metric_table(bugs: DataFrame, synthesis: DataFrame, outputs: DataFrame) -> DataFrame:
    """A row of metrics for each valid defect.

    bugs: instance_id, repo, seed_id, fix_intent, chain_depth, p2f, p2p, chain_alignment; synthesis: instance_id, patch, problem_statement;
    outputs: instance_id, output. What a defect lacks counts as an empty patch or text, or an unknown failure.
    """
    rows = bugs.join(synthesis, "instance_id", "left").join(outputs, "instance_id", "left")
    ratio, impact = scalars.impact(F.col("p2f"), F.col("p2p"))
    made = rows.select(
        *[c for c in ("instance_id", "repo", "seed_id", "fix_intent", "chain_depth")],
        logs.failure_mode(F.col("output")).alias("f"),
        F.col("p2f").alias("p2f_count"),
        F.col("p2p").alias("p2p_count"),
        F.round(ratio, 6).alias("test_impact_ratio"),
        impact.alias("impact_ratio_score"),
        scalars.patch_naturalness(F.col("patch")).alias("patch"),
        scalars.report_informativeness(F.col("problem_statement")).alias("ps"),
        F.coalesce("chain_alignment", F.lit(0.0)).alias("alignment"),
    )
    q, tier = scalars.composite(F.col("f.score"), F.col("impact_ratio_score"), F.col("patch.naturalness_score"), F.col("ps.info_score"), F.col("alignment"))
    fields = lambda s: [F.col(f"{s}.{f.name}").alias(f"{s}_{f.name}") for f in made.schema[s].dataType.fields]
    return made.select("instance_id", "repo", "seed_id", "fix_intent", "chain_depth", F.col("f.failure_mode").alias("failure_mode"), F.col("f.score").alias("failure_mode_score"), "p2f_count", "p2p_count", "test_impact_ratio", "impact_ratio_score", *fields("patch"), *fields("ps"), F.round("alignment", 4).alias("chain_alignment"), q.alias("composite_score"), tier.alias("quality_tier"))


def report(metrics: DataFrame) -> DataFrame:
    """scope, name, n, mean, share_a..share_d: the composite over all, by repository, by intent and by dimension (the mean of each score)."""
    share = lambda t: F.round(F.count_if(F.col("quality_tier") == t) / F.count(F.lit(1)), 6).alias(f"share_{t.lower()}")
    rows = metrics.select(F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), n.cast("string").alias("name"), F.col("composite_score").alias("v"), F.col("quality_tier")) for s, n in (("all", F.lit("")), ("repo", F.col("repo")), ("intent", F.col("fix_intent")))])).alias("r")).select("r.*")
    whole = rows.groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), *[share(t) for t in "ABCD"])
    dims = metrics.select(F.expr("stack(5, 'failure', failure_mode_score, 'impact', impact_ratio_score, 'patch', patch_naturalness_score, 'text', ps_info_score, 'alignment', chain_alignment) AS (name, v)"))
    by_dim = dims.groupBy(F.lit("dimension").alias("scope"), "name").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), *[F.lit(None).cast("double").alias(f"share_{t}") for t in "abcd"])
    return whole.unionByName(by_dim)


def top_modes(metrics: DataFrame, k: int = 10) -> DataFrame:
    """failure_mode, n, rank: the k most frequent kinds of failure over all."""
    counts = metrics.groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "failure_mode"))).where(F.col("rank") <= k)  # a row a kind

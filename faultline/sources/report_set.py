"""The reports of a whole run: chains, synthetic defects, the data set and one row of totals, written as folders of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import save_json


def chain_summaries(chains: DataFrame) -> DataFrame:
    """A row a chain: chain_id, seed_instance_id, repo, fix_intents, path_length, symptom_node, root_cause_node.

    chains: chain_id, instance_id, repo, fix_intent, nodes (an array of ids in order). Without nodes both ends are N/A, without a
    repository it is Unknown; a null intent gives no entry, an empty one Unknown.
    """
    n = F.coalesce(F.size("nodes"), F.lit(0))
    end = lambda at: F.when(n > 0, F.element_at("nodes", at)).otherwise("N/A")
    intent = F.when(F.col("fix_intent") == "", "Unknown").otherwise(F.col("fix_intent"))
    intents = F.array_compact(F.array(intent))
    return chains.select("chain_id", F.col("instance_id").alias("seed_instance_id"), F.coalesce("repo", F.lit("Unknown")).alias("repo"), intents.alias("fix_intents"), F.greatest(n, F.lit(0)).cast("long").alias("path_length"), end(1).alias("symptom_node"), end(-1).alias("root_cause_node"))


#: What a summary of a defect is called there, by its name in the table of defects.
SUMMARY_NAMES = {
    "seed_id": "seed_instance_id",
    "fix_intent": "seed_fix_intent",
    "instance_id": "synthetic_instance_id",
    "repo": "synthetic_repo",
    "problem_statement": "synthetic_problem_statement",
    "patch": "synthetic_patch",
    "chain": "synthetic_chain",
    "injection_patch": "synthetic_injection_patch",
    "test_case_code": "synthetic_test_case_code",
    "injection_strategy": "synthetic_injection_strategy",
}


def _or_empty(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def synthesis_summaries(defects: DataFrame, seeds: DataFrame) -> DataFrame:
    """A row a synthetic defect beside its seed, with the depth of its chain; a defect whose seed is not there has none, one without a status was skipped.

    defects: instance_id, seed_id, repo, fix_intent, problem_statement, patch, chain (array), injection_patch, test_case_code,
    injection_strategy, status, is_valid; seeds: instance_id (each once), metadata.
    """
    beside = seeds.select(F.col("instance_id").alias("__seed"), F.col("metadata").alias("seed_metadata"))
    joined = defects.join(beside, F.col("seed_id") == F.col("__seed"), "left")
    texts = ("injection_patch", "test_case_code")
    named = [(_or_empty(c) if c in texts else F.col(c)).alias(n) for c, n in SUMMARY_NAMES.items()]
    depth = F.greatest(F.coalesce(F.size("chain"), F.lit(0)), F.lit(0)).cast("long")
    return joined.select(*named, "seed_metadata", depth.alias("synthetic_chain_depth"), F.coalesce("status", F.lit("skipped")).alias("validation_status"), F.coalesce("is_valid", F.lit(False)).alias("is_valid_bug"))


def data_set(defects: DataFrame) -> DataFrame:
    """The defects as a data set: id, repository, text, patch, and metadata that says where they come from."""
    meta = F.struct(F.lit(True).alias("is_synthetic"), F.col("seed_id").alias("seed_instance_id"), F.col("fix_intent").alias("seed_fix_intent"), F.col("chain").alias("synthetic_chain"), _or_empty("injection_patch").alias("synthetic_injection_patch"), _or_empty("test_case_code").alias("synthetic_test_case_code"))
    return defects.select("instance_id", "repo", "problem_statement", "patch", meta.alias("metadata"))


def run_report(seeds: DataFrame, chains: DataFrame, defects: DataFrame) -> DataFrame:
    """One row: inputs, chains and defects, the seeds that have a defect, their share as text, and defects a seed. Null seeds of defects are counted as one more."""
    count = F.count(F.lit(1))
    made = defects.agg(count.alias("total_synthetic_instances"), (F.count_distinct("seed_id") + F.max(F.when(F.col("seed_id").isNull(), 1).otherwise(0))).alias("s"))
    # three tables of one row each
    row = seeds.agg(count.alias("total_input_instances")).withColumn("k", F.lit(1)).join(chains.agg(count.alias("total_extracted_chains")).withColumn("k", F.lit(1)), "k").join(made.withColumn("k", F.lit(1)), "k")
    total, hit = F.col("total_input_instances"), F.coalesce("s", F.lit(0)).cast("long")
    rate = F.format_string("%.1f%%", F.coalesce(F.try_divide(100.0 * hit, total), F.lit(0.0)))
    each = F.round(F.coalesce(F.try_divide(F.col("total_synthetic_instances").cast("double"), total), F.lit(0.0)), 3)
    return row.select("total_input_instances", "total_extracted_chains", "total_synthetic_instances", hit.alias("seeds_with_synthetic"), rate.alias("seed_coverage_rate"), each.alias("avg_synthetic_per_seed"))


def save_report_set(seeds: DataFrame, chains: DataFrame, defects: DataFrame, folder: str) -> None:
    """Four folders below `folder`, each whole or not there: 1_extraction/summary, 2_synthesis/summary, 2_synthesis/final_dataset and report, the last one last."""
    save_json(chain_summaries(chains), f"{folder}/1_extraction/summary")
    save_json(synthesis_summaries(defects, seeds), f"{folder}/2_synthesis/summary")
    save_json(data_set(defects), f"{folder}/2_synthesis/final_dataset")
    save_json(run_report(seeds, chains, defects), f"{folder}/report")


def best_details(files: DataFrame) -> DataFrame:
    """instance_id, rank, path, mtime of the best file of each instance, by its rank, then the latest, then by path; files: path, mtime.

    <instance>_rank<n>.json has rank n; any other .json file is of the instance that its name says and has rank 999,999. A number beyond 64 bits
    counts as the largest of them.
    """
    name = F.substring_index("path", "/", -1)
    pattern = r"^(.+?)_rank(\d+)\.json$"
    ranked = name.rlike(pattern)
    instance = F.when(ranked, F.regexp_extract(name, pattern, 1)).otherwise(F.regexp_replace(name, r"\.json$", ""))
    rank = F.when(ranked, F.coalesce(F.regexp_extract(name, pattern, 2).try_cast("long"), F.lit(LARGEST))).otherwise(UNRANKED)
    rows = files.where(name.endswith(".json")).select(instance.alias("instance_id"), F.struct(rank.alias("rank"), (-F.unix_micros("mtime")).alias("age"), "path", "mtime").alias("f"))
    return rows.groupBy("instance_id").agg(F.min("f").alias("f")).select("instance_id", "f.rank", "f.path", "f.mtime")


#: Fixed value: the rank of a file whose name has none.
UNRANKED = 999_999
LARGEST = (1 << 63) - 1

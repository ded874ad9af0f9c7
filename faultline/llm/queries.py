"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, html_extract, knn_quality, lattice, lm_score, minhash, mixing, oracles, packing, quality_rules, secret_scan, substring, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of documents that labels mark as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"), trusted(spark, sf_dir)).withColumn("score", F.round("score", 9))


def op8_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    return knn_quality.knn_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, and its source owns it: a value in many documents of one source is that owner's."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), repo=F.col("doc_id"), owner=F.col("source"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"]))
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), scale=64, shift=1_000_000, top=32)
    each = out.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_toxicity, op3_best_fit_packing, op4_minhash_near_dedup, op5_html_extraction, op6_lattice_near_dedup, op7_lm_score, op8_knn_quality, op9_secret_scan, op10_mixing, op11_substring_dedup, op12_embedding_whitening, op13_hard_negatives)
}
#: Bins, trees and trained models are beyond SQL: the other queries are tested against plain Python.
ORACLES: dict[str, str] = oracles.ORACLES

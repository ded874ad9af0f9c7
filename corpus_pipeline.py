"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. Columns besides id,
text and source are carried along, whatever their names.

Defined results, stage by stage:
- null or empty texts, and texts of fewer than ten words, fail the quality rules; an empty table stays empty;
- null ids: judged by their texts, and passed over where a near copy has an id; null sources are one source;
- repeated rows: one is left by the near-duplicate stage; the mixture may repeat it, and copy tells its draws apart;
- rows that share an id but not a text stay apart, as a hash of the text (key) is part of what names them;
- ties: the smallest id, then the smallest hash, stays of a group; orders of equal draws follow hashes;
- very long texts are judged whole and cut into pieces by the last stage.

The last stage returns doc_id, key, piece, copy, pieces, n_tokens, bin_id, bin_offset, capacity, bin_tokens and text (redacted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import minhash, mixing, packing, quality_rules, secret_scan
from faultline.llm.common import stored
from faultline.llm.queries import trusted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, trusted(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return minhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask; n_chars follows the text."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again as their temperature weights ask for: a row for each draw."""
    return mixing.mix_rows(docs).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text of each document, or piece of one, and its place in a training sequence; copy numbers the draws of one document."""
    return packing.pack_documents(docs, with_text=True)


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("secret_scan", secrets), ("mixing", mixture), ("best_fit_packing", packed)]

#: SQL cannot express the sketches and the packing; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoints, ship

#: The words of every operator: maximal runs without these six characters.
GAP = r"[\x20\x09-\x0D]+"
#: A broadcast side may have this many 8-byte ids (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows in an Arrow batch, so that a batch of very long texts still fits a Python worker.
BATCH_ROWS = 500


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read again, without its lineage."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def python_ready(spark: SparkSession) -> None:
    """Sends the package to the executors, and lowers the session's Arrow batch size to BATCH_ROWS if it is larger."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def flagged(rows: DataFrame, ids: DataFrame, key: str, flag: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """rows with a boolean flag: is rows[key] one of the distinct ids (one column)?

    The ids are counted first. Up to limit they are broadcast; more are joined by a
    shuffle on the key. A null key is flagged false.
    """
    name = ids.columns[0]
    marks = ids.select(F.col(name).alias("__id")).where("__id is not null").distinct().withColumn("__hit", F.lit(True))
    if marks.limit(limit + 1).count() <= limit:
        marks = F.broadcast(marks)
    return rows.join(marks, F.col(key) == F.col("__id"), "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__id", "__hit")


def words_of(text: Column) -> Column:
    """The array of words of a text; empty for null."""
    return F.coalesce(F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body reads it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): each node of the undirected edges with the smallest node it can reach.

    Labels fall to the smallest label among neighbours, then to the label of the label,
    so a chain halves in every round. Only (node, label) rows move, never whole groups,
    and an adaptive skew join splits the edges of a hub. Each round is stored. Nodes are of any ordered type.
    """
    one = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = stored(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("label"), F.lit(True).alias("moved"))
    labels = stored(labels)
    for _ in range(rounds):
        if labels.where("moved").isEmpty():
            break
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("low"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        nxt = low.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label"))
        labels = stored(nxt.select("node", "label", (F.col("label") != F.col("old")).alias("moved")))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))

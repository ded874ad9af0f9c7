"""Watchers as streams: new detail files, progress and usage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .tail import TAIL_BYTES, tails


def new_details(spark: SparkSession, folder: str, schema: StructType, key: str = "instance_id", done: DataFrame | None = None, late: str = "7 days") -> DataFrame:
    """A stream of detail files as they arrive, each key once, without the keys that are done (one column).

    A key is remembered for `late` after its file's time of change, so what is remembered is bounded; what comes again
    later is among the done ones by then.
    """
    rows = spark.readStream.schema(schema).option("multiLine", True).json(folder).withColumn("__at", F.col("_metadata.file_modification_time"))
    if done is not None:
        rows = rows.join(done.select(F.col(done.columns[0]).alias(key)).distinct(), key, "left_anti")
    return rows.withWatermark("__at", late).dropDuplicatesWithinWatermark([key]).drop("__at")


def progress(spark: SparkSession, folder: str, schema: StructType, expected: DataFrame, done_marker: str, by: str = "repo") -> Callable[[DataFrame, int], None]:
    """A handler for drain(): after each batch, counts of results by repository against those expected (by, expected) go to <marker>/progress; when none is missing, <marker>/complete is written.

    A batch counts its own rows alone, into a table of its number under <marker>/arrived, so its work follows its files and not those of the folder;
    a batch that is run again after a failure writes the same table again, and counts stay through a restart. What is summed after a batch is a row a batch and repository.
    """
    def handle(batch: DataFrame, number: int) -> None:
        batch.groupBy(by).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{done_marker}/arrived/batch={number}")
        arrived = spark.read.schema(f"{by} string, n long, batch long").parquet(f"{done_marker}/arrived")
        actual = arrived.groupBy(by).agg(F.sum("n").alias("actual"))
        state =expected.join(actual, by, "full").select(by, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).withColumn("complete", F.col("actual") >= F.col("expected"))
        state.write.mode("overwrite").json(f"{done_marker}/progress")
        if state.where("not complete").isEmpty():
            state.coalesce(1).write.mode("overwrite").json(f"{done_marker}/complete")

    return handle


def ends_with_marker(spark: SparkSession, log: str, marker: str, tail: int = TAIL_BYTES) -> bool:
    """Does the last part of a log hold the marker? For a look from time to time whether to stop a stream; only the file's end is read, whatever its size."""
    return not tails(spark, [log], tail).where(F.col("tail").contains(marker)).isEmpty()


def stop_at_marker(query: StreamingQuery, spark: SparkSession, log: str, marker: str) -> bool:
    """Stops a stream once the log holds the marker; was it stopped?"""
    if ends_with_marker(spark, log, marker):
        query.stop()
        return True
    return False


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Handles all that is there and stops; a later call goes on where this one ended."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals by model of appended usage lines (model, input_tokens, output_tokens)."""
    rows = spark.readStream.schema("model string, input_tokens long, output_tokens long").json(folder)
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def windowed_counts(stream: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event-time window and kind; rows later than `late` are not counted."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")

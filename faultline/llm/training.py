"""Bounded samples of labelled rows, for models that are trained on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that a sample may hold in all; texts that do not fit are left out of training.
MAX_CHARS = 48_000_000


def fitting(sizes: Sequence[int], labels: Sequence[int], max_chars: int) -> list[bool]:
    """Which texts of these sizes to take, in the order given, so that they hold max_chars characters at most.

    Each label may use half of them; what is left over goes to texts of either label. A text that
    does not fit is passed over, and those after it have their turn.
    """
    out = [False] * len(sizes)
    room = {0: max_chars // 2, 1: max_chars // 2}
    for i, (n, y) in enumerate(zip(sizes, labels, strict=True)):
        if n <= room[y]:
            out[i] = True
            room[y] -= n
    left = sum(room.values())
    for i, n in enumerate(sizes):
        if not out[i] and n <= left:
            out[i] = True
            left -= n
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int = MAX_CHARS) -> pd.DataFrame:
    """At most max_rows rows (doc_id, text, label) in the order of a hash of the id, whole texts, half of each label if there are enough.

    docs has doc_id and text, labels doc_id and label (0 or 1; others are ignored). Ids, hashes of texts and
    sizes are chosen from first, so only chosen texts reach the driver. Of an id that repeats with
    several texts the text with the smallest hash is taken; of an id with both labels, label 1.
    """
    marks = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    parts = [marks.where(F.col("label") == y).orderBy(order, "doc_id").limit(max_rows) for y in (0, 1)]
    ids = [p.toPandas() for p in parts]
    half = max_rows // 2
    keep = [min(len(ids[y]), max(half, max_rows - len(ids[1 - y]))) for y in (0, 1)]
    chosen = pd.concat([ids[0][: keep[0]], ids[1][: keep[1]]])
    empty = pd.DataFrame({"doc_id": [], "text": [], "label": []})
    if chosen.empty:
        return empty
    few = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    content = F.xxhash64("text").alias("content")
    # one row an id: at most max_rows
    sized = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(content, F.coalesce(F.length("text"), F.lit(0)).alias("n"))).alias("t")).select("doc_id", "label", "t.content", "t.n", order.alias("k")).toPandas()
    if sized.empty:
        return empty
    sized = sized.sort_values(["k", "doc_id"], ignore_index=True)
    sized = sized[fitting(sized["n"].tolist(), sized["label"].tolist(), max_chars)]
    if sized.empty:
        return empty
    taken = docs.sparkSession.createDataFrame(sized[["doc_id", "label", "content"]], "doc_id long, label int, content long")
    rows = docs.withColumn("content", content).join(F.broadcast(taken), ["doc_id", "content"]).groupBy("doc_id", "label").agg(F.first("text").alias("text"))
    return rows.select("doc_id", "text", "label").toPandas().sort_values("doc_id", ignore_index=True)

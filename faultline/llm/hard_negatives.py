"""Hard negatives of anchors by a vector-approximation file.

The file holds for each vector one byte a dimension: the cell of its component, between marks that are
fitted on a bounded sample. For an anchor and each dimension a table tells the least and the largest
product that a component of a cell may give; sums of looked-up entries bound a score from below and above.

A scan keeps what a vector may still be worth: a vector whose upper bound is under the worst of the best so far is never scored,
nor is one whose bounds lie outside the window asked for. Only the rest is scored, in whole numbers.

1. Positives: for each anchor the best other rows of its label.
2. Windows: for each anchor and positive the best rows of another label whose score lies between two shares of the positive's.

Anchors come in waves of at most WAVE, which are broadcast, so a wave has a bounded size however many anchors
there are; every wave scans the whole file. A task keeps only the best of each anchor over all its rows, and tasks are merged by anchor.

Defined results: rows with a null label, a null or empty vector or a null or non-finite component take no part. Vectors of another length
than the anchor's are no partners of it. Repeated rows are rows of their own, and so are anchors that share an id. A null
id is never an anchor, keeps its label, and comes last among ties. Scores beyond 64 bits are an error.
Extra columns are ignored. An anchor without positives, or a positive without rows in its window, gives no row; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, stored

#: Cells of a dimension; the rows that the marks between them are fitted on; anchors of a wave; rows looked at together.
CELLS, SAMPLE, WAVE, ROWS = 64, 20_000, 4096, 4096
#: Stands for a null id in comparisons, so that it comes last.
_LAST = (1 << 63) - 1


def fit_marks(x: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """For each dimension cells - 1 rising marks, equally many values of the sample between two of them."""
    q = np.quantile(x, np.arange(1, cells) / cells, axis=0, method="inverted_cdf") if len(x) else np.zeros((cells - 1, x.shape[1]))
    return np.ascontiguousarray(q.T)


def cells_of(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The cell of each component: the number of marks at or below it."""
    return np.stack([np.searchsorted(m, x[:, d], "right") for d, m in enumerate(marks)], axis=1).astype(np.uint8)


def tables(anchor: np.ndarray, marks: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of each dimension and cell, given the least and largest component of a dimension; all whole numbers."""
    low = np.concatenate([least[:, None], np.maximum(marks, least[:, None])], axis=1)
    high = np.concatenate([np.maximum(marks - 1, least[:, None]), most[:, None]], axis=1)
    high = np.minimum(high, most[:, None])
    a, b = low * anchor[:, None], high * anchor[:, None]
    return np.minimum(a, b), np.maximum(a, b)


class _File:
    """A part of the file, and the vectors behind it."""

    def __init__(self, rid: np.ndarray, vec: np.ndarray, label: np.ndarray, cells: np.ndarray, x: np.ndarray):
        self.rid, self.vec, self.label, self.x = rid, vec, label, x
        self.slots = cells.astype(np.int64) + np.arange(cells.shape[1]) * CELLS

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.take(low.ravel(), self.slots).sum(1), np.take(high.ravel(), self.slots).sum(1)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.x[rows] @ anchor


def _best(k: int, *parts: np.ndarray) -> np.ndarray:
    """The k first of rows (score, id, rid) by falling score, then rising id."""
    rows = np.concatenate(parts)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:k]]


def _at_least(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value, if there are as many."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


_NONE = np.zeros((0, 3), np.int64)


def positives_in(part: _File, anchors: dict, tabs: list, best: list[np.ndarray], k: int) -> None:
    """Merges into best[i] the best rows of anchor i's label in a part."""
    for i, (low, high) in enumerate(tabs):
        mine = np.flatnonzero((part.label == anchors["label"][i]) & (part.rid != anchors["rid"][i]))
        if not len(mine):
            continue
        lo, hi = (np.take(t.ravel(), part.slots[mine]).sum(1) for t in (low, high))
        floor = max((f for f in (_at_least(lo, k), int(best[i][-1, 0]) if len(best[i]) == k else None) if f is not None), default=None)
        may = mine if floor is None else mine[hi >= floor]
        if len(may):
            best[i] = _best(k, best[i], np.stack([part.scores(may, anchors["x"][i]), part.vec[may], part.rid[may]], axis=1))


def window_in(part: _File, anchors: dict, tabs: list, best: list[list[np.ndarray]], k: int) -> None:
    """Merges into best[i][j] the best rows of other labels whose score lies in window j of anchor i."""
    for i, (low, high) in enumerate(tabs):
        other = part.label != anchors["label"][i]
        lo, hi = part.bounds(low, high)
        known: dict[int, int] = {}
        for j, (floor, top) in enumerate(anchors["windows"][i]):
            may = other & (hi >= floor) & (lo <= top)
            sure = lo[may & (lo >= floor) & (hi <= top)]
            least = max((f for f in (_at_least(sure, k), int(best[i][j][-1, 0]) if len(best[i][j]) == k else None) if f is not None), default=None)
            rows = np.flatnonzero(may if least is None else may & (hi >= least))
            new = [r for r in rows.tolist() if r not in known]
            if new:
                known.update(zip(new, part.scores(np.array(new), anchors["x"][i]).tolist(), strict=True))
            score = np.array([known[r] for r in rows.tolist()], np.int64)
            fits = (score >= floor) & (score <= top)
            if fits.any():
                rows = rows[fits]
                best[i][j] = _best(k, best[i][j], np.stack([score[fits], part.vec[rows], part.rid[rows]], axis=1))


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[_File]:
    """Rows (rid, vec_id, label, cells, x) of one length, about ROWS at a time."""
    held: list[pa.RecordBatch] = []
    for b in _then_none(batches):
        if b is not None:
            held.append(b)
        if held and (b is None or sum(len(h) for h in held) >= ROWS):
            t = pa.Table.from_batches(held).combine_chunks()
            held = []
            if len(t):
                x = t["x"].combine_chunks() if t["x"].num_chunks != 1 else t["x"].chunk(0)
                cells = np.frombuffer(b"".join(t["cells"].to_pylist()), np.uint8).reshape(-1, length)
                yield _File(t["rid"].to_numpy(), t["vec_id"].to_numpy(), t["label"].to_numpy(), cells, x.flatten().to_numpy().reshape(-1, length))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _approximate(marks: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(np.asarray(b.column(3).offsets))
            cells: list[bytes] = [b""] * len(b)
            for length in np.unique(size):
                rows = np.flatnonzero(size == length)
                found = cells_of(b.column(3).take(pa.array(rows)).flatten().to_numpy().reshape(-1, length), marks[int(length)])
                for r, c in zip(rows.tolist(), found, strict=True):
                    cells[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cells, pa.binary()), b.column(3)], names=["rid", "vec_id", "label", "cells", "x"])

    return run


def _exact(x: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
    top = max(int(np.abs(least).max(initial=0)), int(np.abs(most).max(initial=0)))
    if len(least) * top * max(1, int(np.abs(x).max(initial=0))) >= 1 << 63:
        raise OverflowError("scores of these vectors need more than 64 bits")


def approximation_file(rows: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(rid, vec_id, label, cells, x) of all rows that take part, stored, and for each length the marks with the least and largest components."""
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & label.isNotNull()
    whole = rows.where(F.coalesce(sound, F.lit(False))).select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("vec_id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(scale * x).cast("long")).alias("x"))
    whole = stored(whole)
    n = whole.count()
    # the sample is chosen by a hash, so it is the same whatever the partitions
    sample = whole.select("x", F.xxhash64("vec_id", "x").alias("o")).orderBy("o").limit(SAMPLE).select("x").collect() if n else []
    ends = whole.select(F.size("x").alias("length"), F.posexplode("x").alias("d", "c")).groupBy("length", "d").agg(F.min("c").alias("least"), F.max("c").alias("most")).collect()
    by_length: dict[int, list] = {}
    for r in sorted(ends):
        by_length.setdefault(r.length, []).append((r.least, r.most))
    fitted = {}
    for length, pairs in by_length.items():
        x = np.array([r.x for r in sample if len(r.x) == length], np.int64).reshape(-1, length)
        least, most = np.array(pairs, np.int64).T
        fitted[length] = (fit_marks(x).astype(np.int64), least, most)
    marks = {k: m for k, (m, _, _) in fitted.items()}
    return stored(whole.select("rid", "vec_id", "label", "x").mapInArrow(_approximate(marks), "rid long, vec_id long, label long, cells binary, x array<long>")), fitted


def _scan(shared, k: int, length: int, windows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each partition the k best rows of each anchor, or of each window of it: (anchor, window, score, vec_id, rid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (marks, least, most) = shared.value
        tabs = [tables(a, marks, least, most) for a in anchors["x"]]
        best: list = [[_NONE] * len(w) for w in anchors["windows"]] if windows else [_NONE] * len(tabs)
        for part in _parts(batches, length):
            (window_in if windows else positives_in)(part, anchors, tabs, best, k)
        keys = [(i, j, b) for i, x in enumerate(best) for j, b in enumerate(x if windows else [x]) if len(b)]
        if keys:
            rows = np.concatenate([b for _, _, b in keys])
            n = [len(b) for _, _, b in keys]
            anchor, window = np.repeat([anchors["rid"][i] for i, _, _ in keys], n), np.repeat([j for _, j, _ in keys], n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchor, window, rows[:, 0], rows[:, 1], rows[:, 2])], names=["anchor", "window", "score", "vec_id", "rid"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window; each task gives at most k, so a group is as large as the number of tasks allows."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    anchor tells which rows ask (a condition on the id column), label is the class of a row. Components become floor(scale * x). A negative's
    score lies between low and high percent of the positive's.
    """
    spark = rows.sparkSession
    python_ready(spark)
    file, fitted = approximation_file(rows, id_col, label, vector_col, scale)
    asking = stored(file.where(F.col("vec_id") != _LAST).withColumnRenamed("vec_id", id_col).where(anchor).select("rid", F.col(id_col).alias("vec_id"), "label", "x", F.size("x").alias("length")))
    schema = "anchor long, window long, score long, vec_id long, rid long"
    out = []
    for length, (marks, least, most) in sorted(fitted.items()):
        mine, of_length = asking.where(F.col("length") == length), file.where(F.size("x") == length)
        waves = -(-mine.count() // WAVE)
        for wave in range(waves):
            rows_of = mine if waves == 1 else mine.where(F.pmod(F.xxhash64("rid"), F.lit(waves)) == wave)
            got = sorted(rows_of.collect(), key=lambda r: r.rid)
            if not got:
                continue
            anchors = {"rid": np.array([r.rid for r in got]), "label": np.array([r.label for r in got]), "x": np.array([r.x for r in got], np.int64)}
            _exact(anchors["x"], least, most)
            shared = spark.sparkContext.broadcast((anchors, (marks, least, most)))
            best = stored(_ranked(of_length.mapInArrow(_scan(shared, positives, length, False), schema), positives).select("anchor", F.col("rank").alias("j"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")))
            # at most WAVE times positives rows: the windows go out with the anchors
            of = {(r.anchor, r.j): r.positive_score for r in best.collect()}
            anchors["windows"] = []
            for r in got:
                scores = [of[r.rid, j] for j in range(1, positives + 1) if (r.rid, j) in of]
                anchors["windows"].append([(-(-low * s // 100), high * s // 100) for s in scores])
            shared = spark.sparkContext.broadcast((anchors, (marks, least, most)))
            ranked = _ranked(of_length.mapInArrow(_scan(shared, negatives, length, True), schema), negatives)
            ranked = ranked.select("anchor", (F.col("window") + 1).alias("j"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            names = rows_of.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
            out.append(ranked.join(best, ["anchor", "j"]).join(names, "anchor"))
    null = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    columns = ("anchor_id", null("positive_id"), F.col("rank").cast("int").alias("rank"), null("negative_id"), "positive_score", "negative_score")
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for other in out[1:]:
        whole = whole.unionByName(other)
    return whole.select(*columns)

"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are word hashes and word shapes (A-Z, a-z and other letters, digits, and each kind of
punctuation, with runs cut to one), hashed into DIMS buckets, weighted by
log(1 + count) and the inverse document frequency over the whole corpus, and normalised. A
truncated singular value decomposition of the labelled sample's matrix (a randomised range
finder with power steps) gives RANK latent directions. The sample's latent vectors are broadcast;
every document's vector is multiplied with all of them in blocks, exactly, and the labels of
its K nearest vote, weighted by their cosine (to the fourth power, so that near ones count).

Training uses at most max_rows labelled documents, half of each label if there are enough; the
votes are divided by how often each label was drawn. Document frequencies are counted
over all documents.

Defined results: all neighbours with the cosine of the K-th nearest vote with it; a null or empty text has no direction and gets the share of label 1 among the
labelled; without labels of both kinds every score is that share, or 0.5 without any; null ids are scored
and never trained on; repeated rows are scored each, other columns are ignored; an empty table gives
an empty result; long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import python_ready
from .training import labelled_sample

MAX_ROWS, DIMS, RANK, K = 4000, 1 << 15, 48, 25
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, sorted, and their counts."""
    body, at = tokens.flat(column)
    starts, ends, first = tokens.spans(body, at)
    word = tokens.hashed(body, starts, ends, lower=False) if len(starts) else np.zeros(0, np.uint64)
    kinds = _SHAPE[body]
    turn = np.concatenate([[True], kinds[1:] != kinds[:-1]]) if len(body) else np.zeros(0, bool)
    turn[starts] = True
    # the shape: the hash of the word's runs, each by its kind
    runs = np.concatenate([[0], np.cumsum(turn)])
    short = kinds[turn]
    shape = tokens.hashed(short, runs[starts], runs[ends], lower=False) if len(starts) else word
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    bucket = np.concatenate([word % np.uint64(DIMS // 2), np.uint64(DIMS // 2) + tokens.mix(shape + np.uint64(1)) % np.uint64(DIMS // 2)]).astype(np.int64)
    pair, count = np.unique(np.concatenate([doc, doc]) * DIMS + bucket, return_counts=True)
    return pair // DIMS, pair % DIMS, count


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents hold each bucket, and the number of documents. texts: one column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            df += np.bincount(term_counts(b.column(0))[1], minlength=DIMS)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*np.flatnonzero(df), DIMS], pa.int64()), pa.array([*df[df > 0], n], pa.int64())], names=["bucket", "n"])

    sums = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # DIMS + 1 rows at most
    out = np.zeros(DIMS + 1, np.int64)
    out[sums["bucket"].to_numpy(int)] = sums["n"].to_numpy(int)
    return out[:DIMS], int(out[DIMS])


class Space:
    """Latent directions of a labelled sample, and its vectors, labels and votes."""

    def __init__(self, texts: list[str | None], labels: np.ndarray, shares: tuple[float, float], df: np.ndarray, n: int, rank: int = RANK, seed: int = 7) -> None:
        self.idf = (np.log((n + 1) / (df + 1)) + 1e-3).astype(np.float32)
        self.labels = np.asarray(labels, np.float32)
        # a label that was drawn more often than it occurs counts for less
        drawn = np.array([(self.labels == y).mean() if len(self.labels) else 1.0 for y in (0, 1)])
        self.prior = shares[1] / sum(shares) if sum(shares) else 0.5
        self.votes = np.where(self.labels == 1, 1 / max(drawn[1], 1e-9), 1 / max(drawn[0], 1e-9)).astype(np.float32)
        self.basis = np.zeros((DIMS, rank), np.float32)
        self.vectors = np.zeros((0, rank), np.float32)
        self.one_label = len(set(self.labels.tolist())) < 2
        if self.one_label:
            return
        doc, bucket, value = self._weigh(pa.array(texts, pa.string()))
        m = len(texts)
        q = np.random.default_rng(seed).standard_normal((DIMS, rank + 8)).astype(np.float32)
        starts = np.searchsorted(doc, np.arange(m + 1))

        def times(x: np.ndarray) -> np.ndarray:  # the sparse matrix times x
            out = np.zeros((m, x.shape[1]), np.float32)
            for i in range(m):
                a, b = starts[i], starts[i + 1]
                out[i] = value[a:b] @ x[bucket[a:b]]
            return out

        def back(y: np.ndarray) -> np.ndarray:  # its transpose times y
            out = np.zeros((DIMS, y.shape[1]), np.float32)
            for i in range(m):
                a, b = starts[i], starts[i + 1]
                out[bucket[a:b]] += value[a:b, None] * y[i]
            return out

        for _ in range(3):
            q = np.linalg.qr(back(np.linalg.qr(times(q))[0]))[0].astype(np.float32)
        _, _, vt = np.linalg.svd(times(q), full_matrices=False)
        self.basis = (q @ vt.T)[:, :rank].astype(np.float32)
        self.vectors = self._unit(times(self.basis))

    def _weigh(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, bucket, count = term_counts(column)
        value = np.log1p(count).astype(np.float32) * self.idf[bucket]
        norm = np.sqrt(np.bincount(doc, value**2, len(column)))
        return doc, bucket, (value / np.maximum(norm[doc], 1e-9)).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def embed(self, column: pa.Array) -> np.ndarray:
        """The latent unit vector of each text; zero if it has none."""
        doc, bucket, value = self._weigh(column)
        starts = np.searchsorted(doc, np.arange(len(column) + 1))
        out = np.zeros((len(column), self.basis.shape[1]), np.float32)
        for i in range(len(column)):
            a, b = starts[i], starts[i + 1]
            if b > a:
                out[i] = value[a:b] @ self.basis[bucket[a:b]]
        return self._unit(out)

    def score(self, column: pa.Array, k: int = K) -> np.ndarray:
        """The weighted share of label 1 among the k nearest."""
        if self.one_label or not len(column):
            return np.full(len(column), self.prior)
        x = self.embed(column)
        cosine = x @ self.vectors.T
        k = min(k, cosine.shape[1])
        least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        weight = np.square(np.square(np.maximum(cosine, 0))) * self.votes * (cosine >= least)
        total = weight.sum(1)
        return np.where(total > 0, (weight @ self.labels) / np.maximum(total, 1e-12), self.prior).astype(float)


def knn_quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    held_out: a condition over doc_id; labels of rows for which it holds are not learned from.
    """
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(~held_out)
    shares = known.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    sample = labelled_sample(rows, known, max_rows)
    df, n = document_frequencies(rows.select("text"))
    space = spark.sparkContext.broadcast(Space(sample["text"].tolist(), sample["label"].to_numpy(float), (shares[0], shares[1]), df, n))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = space.value.score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    given = rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return given.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")

"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence (up to a word that ends in . ! or ?, or the end of a line) has the score
sigmoid(bias + the sum of the weights of its distinct words); a document has the noisy-or
1 - product(1 - sentence scores). Weights are trained by full-batch proximal gradient steps on
the likelihood of document labels, so a toxic document must hold at least one toxic sentence,
and no sentence of a clean one may be. An L1 penalty leaves words that prove nothing at 0.

Words are lower-cased (A-Z) and stripped of punctuation at either end; their prefixes of 5 to 8
bytes count too, so inflected forms of a stem share what was learned. Training uses at most
`max_rows` labelled documents of `max_chars` characters in all (those with the smallest hashes of
their ids, half of them of either label if there are enough); the vocabulary holds words that at
least `min_df` of these share and whose shares among toxic and clean documents differ by `min_z`
standard errors. Everything else runs over all documents.

Defined results: null or empty texts have one empty sentence; null ids are scored and never
trained on; without labels of both kinds every score is 0.5; repeated rows are scored each, other columns are
ignored; an empty table gives an empty result; long texts are scored whole.
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

MAX_ROWS, MAX_CHARS, MIN_DF, MIN_Z, PREFIXES = 4000, 16_000_000, 3, 1.5, (5, 6, 7, 8)
#: Characters of text whose features are held at a time in training, besides one text.
CHUNK_CHARS = 400_000
_STRIP = np.zeros(256, bool)
_STRIP[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True
_END = np.zeros(256, bool)
_END[np.frombuffer(b".!?", np.uint8)] = True


def bare(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word without punctuation at either end, equal where nothing is left: its first and last other byte, found among all such bytes in one pass."""
    solid = np.flatnonzero(~_STRIP[body])
    before, through = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = through > before
    lo, hi = ends.copy(), ends.copy()
    lo[some], hi[some] = solid[before[some]], solid[through[some] - 1] + 1
    return lo, hi


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each feature (a word or a prefix) its hash and sentence; for each sentence its text, and byte start and end in that text.

    Every text has a sentence at least.
    """
    body, at = tokens.flat(column)
    starts, ends, first = tokens.spans(body, at)
    n, texts = len(starts), len(at) - 1
    doc = np.repeat(np.arange(texts), np.diff(first))
    lines = np.concatenate([[0], np.cumsum(body == 10)])
    stop = _END[body[ends - 1]] if n else np.zeros(0, bool)
    if n:
        begin = np.ones(n, bool)
        begin[1:] = stop[:-1] | (doc[1:] != doc[:-1]) | (lines[starts[1:]] != lines[ends[:-1]])
    else:
        begin = np.zeros(0, bool)
    empty = np.flatnonzero(np.diff(first) == 0)
    sentence = np.cumsum(begin) - 1
    heads = np.flatnonzero(begin)
    tails = np.concatenate([heads[1:], [n]]) - 1 if n else heads
    s_doc = np.concatenate([doc[heads], empty])
    s_lo = np.concatenate([starts[heads] - at[doc[heads]], np.zeros(len(empty), np.int64)])
    s_hi = np.concatenate([ends[tails] - at[doc[heads]], np.zeros(len(empty), np.int64)])
    lo, hi = bare(body, starts, ends)
    # features: whole words, then prefixes, told apart by the number that is mixed in
    full = np.flatnonzero(lo < hi)
    hashes, owner = [tokens.hashed(body, lo[full], hi[full])], [sentence[full]]
    for size in PREFIXES:
        long = full[hi[full] - lo[full] > size]
        hashes.append(tokens.mix(tokens.hashed(body, lo[long], lo[long] + size) + np.uint64(size)))
        owner.append(sentence[long])
    return np.concatenate(hashes), np.concatenate(owner), s_doc, s_lo, s_hi


def features(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Distinct (sentence, index into the sorted vocabulary) pairs; each sentence's text; its byte span."""
    hashes, sentence, s_doc, lo, hi = sentences(column)
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), s_doc, (lo, hi)
    k = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[k] == hashes
    pair = np.unique(sentence[known] * len(vocabulary) + k[known])
    return pair // len(vocabulary), pair % len(vocabulary), s_doc, (lo, hi)


def noisy_or(scores: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """1 - product of (1 - score) over the sentences of each text."""
    out = np.zeros(texts)
    np.add.at(out, doc, np.log1p(-np.minimum(scores, 1 - 1e-12)))
    return -np.expm1(out)


def _chunks(texts: list[str | None], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """The number of the first text and the texts of consecutive chunks."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars or i + 1 == len(texts):
            yield first, pa.array(texts[first : i + 1], pa.string())
            first, held = i + 1, 0


def vocabulary_of(texts: list[str | None], y: np.ndarray, min_df: int, min_z: float) -> np.ndarray:
    """Sorted hashes of the features that at least min_df texts share and that either label prefers by min_z standard errors."""
    known, df, toxic = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for first, part in _chunks(texts):
        hashes, sentence, s_doc, _, _ = sentences(part)
        doc = s_doc[sentence]
        order = np.lexsort((doc, hashes))
        h, doc = hashes[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        some, at = np.unique(h[new], return_inverse=True)
        count, bad = np.bincount(at, minlength=len(some)), np.bincount(at, y[first + doc[new]], len(some))
        known, at = np.unique(np.concatenate([known, some]), return_inverse=True)
        df = np.bincount(at, np.concatenate([df, count]), len(known))
        toxic = np.bincount(at, np.concatenate([toxic, bad]), len(known))
    n1 = y.sum()
    n0 = len(y) - n1
    share = df / len(y)
    z = (toxic / n1 - (df - toxic) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return known[(df >= min_df) & (np.abs(z) >= min_z)]


def train(texts: list[str | None], labels: np.ndarray, min_df: int = MIN_DF, min_z: float = MIN_Z, steps: int = 200, penalty: float = 3e-4) -> dict[str, np.ndarray]:
    """The sorted vocabulary (hashes), its weights and the bias."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return {"vocabulary": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": np.zeros(1)}
    vocabulary = vocabulary_of(texts, y, min_df, min_z)
    found, n_s = [], 0
    for first, part in _chunks(texts):
        s, k, s_doc, _ = features(part, vocabulary)
        found.append(((s + n_s).astype(np.int32), k.astype(np.int32), (s_doc + first).astype(np.int32)))
        n_s += len(s_doc)
    s, k, s_doc = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    n_s, n_d = len(s_doc), len(y)
    # both labels weigh the same
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(len(vocabulary)), -np.log(max(2.0, 4.0 * n_s / n_d))
    v, g2, mom = np.zeros(len(w) + 1), np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(s, w[k], n_s)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        keep = np.bincount(s_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n_d)
        q = np.clip(-np.expm1(keep), 1e-7, 1 - 1e-7)
        # d loss / d z of a sentence: p for a clean document, -p (1 - q) / q for a toxic one
        slope = share * np.where(y == 1, -(1 - q) / q, 1.0)
        d = slope[s_doc] * p
        grad = np.concatenate([np.bincount(k, d[s], len(w)), [d.sum()]])
        mom = 0.9 * mom + 0.1 * grad
        g2 = 0.99 * g2 + 0.01 * grad**2
        rate = 0.1 / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-4)
        v = np.concatenate([w, [b]]) - rate * mom / (1 - 0.9**step)
        w = np.sign(v[:-1]) * np.maximum(0, np.abs(v[:-1]) - rate[:-1] * penalty)
        b = v[-1]
    used = w != 0
    return {"vocabulary": vocabulary[used], "weights": w[used], "bias": np.array([b])}


def score_texts(column: pa.Array, model: dict[str, np.ndarray], least: float = 0.5) -> tuple[np.ndarray, list[list[list[int]]]]:
    """The score of each text, and byte spans (start, end) of its sentences that score at least `least`."""
    s, k, s_doc, (lo, hi) = features(column, model["vocabulary"])
    n = len(s_doc)
    z = model["bias"][0] + np.bincount(s, model["weights"][k], n) if len(s) else np.full(n, model["bias"][0])
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    offending: list[list[list[int]]] = [[] for _ in range(len(column))]
    trained = len(model["vocabulary"]) > 0
    for i in np.flatnonzero(p >= least) if trained else []:
        offending[s_doc[i]].append([int(lo[i]), int(hi[i])])
    return (noisy_or(p, s_doc, len(column)) if trained else np.full(len(column), 0.5)), offending


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted, offending (byte spans in UTF-8), n_offending.

    held_out: a condition over doc_id; labels of rows for which it holds are not learned from.
    """
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = labelled_sample(rows, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(~held_out), max_rows, max_chars)
    model = spark.sparkContext.broadcast(train(sample["text"].tolist(), sample["label"].to_numpy(float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offending = score_texts(b.column(2), model.value)
            predicted = (values >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(values), pa.array(predicted), pa.array(offending, pa.list_(pa.list_(pa.int64()))), pa.array([len(x) for x in offending], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "offending", "n_offending"],
            )

    given = rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return given.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, offending array<array<bigint>>, n_offending long")



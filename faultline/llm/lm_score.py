"""Cross-entropy difference of two matched n-gram language models.

A target model (texts of trusted documents) and a background model (all documents) are bigram
models of the same form over one vocabulary, the V distinct words of the corpus: every word and every
pair of words is counted by its own 63-bit hash. The probability of a word w after h is

    BIGRAM * c(h, w) / c(h) + UNIGRAM * c(w) / N + FLOOR / V

with c(w) / N in place of the first share where h was never seen or w begins a text, and 1 / V in place
of c(w) / N in a model without words. Each part is a distribution over the vocabulary and
the end of a text, so the whole is one. Every token of a document adds
ln p_target - ln p_background; the score is the mean over its tokens, so it is the background
cross-entropy less the target's, in nats a token.

Both models leave out the document that they score (its own counts are taken off), so a text
is not known to a model because it was counted itself; a text that occurs twice is known.

Counts are taken over all texts and are never gathered on one machine. The documents are dealt
at random into parts of bounded text, as many as the input asks for. A part counts its n-grams and cuts their
sorted hashes into ranges; a range, of which there are as many as parts, sums what all parts sent
and answers each with the totals of its n-grams, in the order they came. So a word that all texts
hold sends one number a part, and what the models hold grows with the input.

Defined results: null or empty texts and texts without words have n_tokens 0 and score 0; with no
target text every score is 0; null ids are scored and belong to the background alone; repeated rows count and are
scored each; other columns are ignored; an empty table gives an empty result; long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import flagged, python_ready

BIGRAM, UNIGRAM, FLOOR = 0.6, 0.39, 0.01
#: Bytes of text in a part, apart from a single larger text.
PART_BYTES = 5_000_000


class Grams:
    """The n-grams of a part: `keys` holds the sorted distinct ones, words even and pairs odd."""

    def __init__(self, column: pa.ChunkedArray):
        h, first = tokens.words(column)
        self.size = np.diff(first)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.follows = np.ones(len(h), bool)
        self.follows[first[:-1][self.size > 0]] = False
        before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])[: len(h)]
        pairs = tokens.mix(before * np.uint64(3) + h)[self.follows] | np.uint64(1)
        self.keys, at = np.unique(np.concatenate([h & ~np.uint64(1), pairs]), return_inverse=True)
        #: where in keys each token's word and, for tokens that follow another, its pair are
        at = at.astype(np.int32)
        self.word, self.pair = at[: len(h)], at[len(h) :]

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How often each key occurs in the tokens that `of` marks."""
        n = len(self.keys)
        return np.bincount(self.word[of], minlength=n) + np.bincount(self.pair[of[self.follows]], minlength=n)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each token's word, and each following token's pair, occurs in the token's own text."""
        out = []
        for doc, key in ((self.doc, self.word), (self.doc[self.follows], self.pair)):
            _, at, n = np.unique(doc.astype(np.int64) * len(self.keys) + key, return_inverse=True, return_counts=True)
            out.append(n[at].astype(np.int32))
        return out[0], out[1]

    def log_probability(self, counts: np.ndarray, words: int, vocabulary: int, own: tuple[np.ndarray, np.ndarray], held: np.ndarray) -> np.ndarray:
        """ln p of each token under the model with these counts of keys and so many words in all.

        held: which texts the model has counted; these are left out.
        """
        mine = held[self.doc]
        word = counts[self.word] - own[0] * mine
        total = (words - self.size * held)[self.doc]
        share = np.where(total > 0, word / np.maximum(total, 1), 1 / max(1, vocabulary))
        pair = share.copy()
        after = np.flatnonzero(self.follows)
        context = word[after - 1]
        pair[after] = np.where(context > 0, (counts[self.pair] - own[1] * mine[after]) / np.maximum(context, 1), share[after])
        return np.log(BIGRAM * pair + UNIGRAM * share + FLOOR / max(1, vocabulary))


def _packed(x: np.ndarray) -> bytes:
    """8-byte numbers byte by byte, all lowest ones first: a shuffle's compression shrinks the equal high ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([_unpacked(x, np.int64) for x in column.to_pylist()])


def _count(parts: int):
    def count(docs: pa.Table) -> pa.Table:
        """One row for each range: part, range and, of the keys in it, the steps between hashes and the counts."""
        grams = Grams(docs["text"])
        aim = np.asarray(docs["target"].to_numpy(), bool)[grams.doc]
        target, all_ = grams.counts(aim), grams.counts(np.ones(len(aim), bool))
        ranges = ((grams.keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cut = np.searchsorted(ranges, np.arange(parts + 1, dtype=np.uint64)).tolist()
        steps = np.diff(grams.keys, prepend=np.uint64(0))
        steps[[a for a in cut[:-1] if a < len(steps)]] = grams.keys[[a for a in cut[:-1] if a < len(steps)]]  # a range's first is whole
        blobs = [pa.array([_packed(x[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (steps, target, all_)]
        part = pa.array(np.full(parts, docs["part"][0].as_py()), pa.int64())
        return pa.Table.from_arrays([part, pa.array(np.arange(parts), pa.int64()), *blobs], names=["part", "range", "keys", "target", "background"])

    return count


def _total(sent: pa.Table) -> pa.Table:
    """Of one range, one row for each part: the totals of its keys, how many words the range holds, and how many distinct ones."""
    keys = np.concatenate([np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in sent["keys"].to_pylist()])
    ends = np.cumsum([len(x) // 8 for x in sent["keys"].to_pylist()]).tolist()
    distinct, at = np.unique(keys, return_inverse=True)
    word, out = (keys & np.uint64(1)) == 0, [sent["part"], sent["range"]]
    words = []
    for name in ("target", "background"):
        own = _joined(sent[name])
        # sums of whole numbers below 2**53 are exact
        total = np.bincount(at, own, len(distinct)).astype(np.int64)[at]
        out.append(pa.array([_packed(total[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()))
        words.append(pa.array(np.full(len(ends), own[word].sum()), pa.int64()))
    words.append(pa.array(np.full(len(ends), ((distinct & np.uint64(1)) == 0).sum()), pa.int64()))
    return pa.Table.from_arrays([*out, *words], names=["part", "range", "target", "background", "n_target", "n_background", "n_words"])


def _score(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """The number of tokens of each text of a part, and its mean loss difference."""
    grams = Grams(docs["text"])
    totals = totals.sort_by("range")
    n_target, n_background, vocabulary = (int(totals[x].to_numpy().sum()) for x in ("n_target", "n_background", "n_words"))
    value = np.zeros(len(docs))
    counts = [_joined(totals[x]) for x in ("target", "background")]
    if any(len(c) != len(grams.keys) for c in counts):
        raise RuntimeError("the rows were dealt in two ways: give a table that is read from files or stored")
    if n_target:
        own, aim = grams.own(), np.asarray(docs["target"].to_numpy(), bool)
        target = grams.log_probability(counts[0], n_target, vocabulary, own, aim)
        background = grams.log_probability(counts[1], n_background, vocabulary, own, np.ones(len(aim), bool))
        value = np.bincount(grams.doc, target - background, len(docs)) / np.maximum(grams.size, 1)
    return pa.Table.from_arrays([docs["doc_id"], pa.array(grams.size, pa.int64()), pa.array(value, pa.float64())], names=["doc_id", "n_tokens", "score"])


def lm_score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, score (higher: nearer to the target). target_ids: one column of ids.

    docs is read from files or stored, so that a second reading gives its rows in the same places.
    """
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # rows are dealt by their place, so no text or id fills a part however often it occurs; both uses read one shuffle,
    # and _score would notice if they did not
    numbered = rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("long"))
    dealt = flagged(numbered, target_ids, "doc_id", "target")
    sent = dealt.groupBy("part").applyInArrow(_count(parts), "part long, range long, keys binary, target binary, background binary")
    totals = sent.groupBy("range").applyInArrow(_total, "part long, range long, target binary, background binary, n_target long, n_background long, n_words long")
    return dealt.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(_score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double")

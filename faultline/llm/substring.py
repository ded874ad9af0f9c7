"""Removal of passages that an earlier document holds, by compressed full-text indexes.

A window is `window` consecutive words of one document. Each word is removed that lies in a window
whose words also stand, in this order, in a document with a smaller id.

1. Every window names the word n-gram in it with the smallest hash; windows in a row that name the same one are a
   segment. Equal windows name equal n-grams, so an n-gram in one document alone needs no search.
   Segments of equal words are counted together: all but those of their smallest document go as a whole.
2. What is left, the first copy of each distinct segment whose n-gram has several, is dealt out by n-gram to shards.
   Each shard builds an FM-index of its segments (fm_index) and streams them through it: backward search gives the
   matches of at least `window` words that begin in a smaller document.
3. An n-gram with more than HOT distinct segments is cut into its windows, each a segment named by all its words. They go
   the way of step 1, so no shard holds an n-gram without bound, and no pair of copies is ever made.

Words are compared by 64-bit hashes of their bytes, a window by all hashes of its words.

Defined results: words are runs of characters other than space, \\t, \\n, \\v, \\f and \\r, unchanged; null and empty texts have none.
A null id is smaller than no id and has none smaller: such a row keeps all words and is no source. Rows that share an id are no
sources for each other; repeated rows get equal results. Texts shorter than a window stay. Columns
besides id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import python_ready, stored
from .fm_index import FMIndex

#: Words of a window and of the n-grams that route them.
WINDOW, GRAM = 50, 10
#: Distinct segments that one n-gram may bring into a shard.
HOT = 1000
#: Words of a shard, about.
SHARD_WORDS = 200_000
#: Window starts looked at together, so that very long texts need bounded memory.
SLICE = 1 << 20
#: The low bits of a sliding minimum hold the place.
_PLACE = np.uint64((1 << 28) - 1)


class _Spans:
    """Hashes of any spans of a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        up, self.down = tokens._powers(1 << max(1, int(len(words)).bit_length()))
        self.run = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.run[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tokens.mix((self.run[end] - self.run[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def segments(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, begin, end, gram hash, hash of the words) of the segments of texts words[first[k]:first[k + 1]]; begin and end count within the text."""
    for lo in range(0, len(words), SLICE):
        part = words[lo : lo + SLICE + window - 1]
        text = np.searchsorted(first, np.arange(lo, lo + len(part)), "right") - 1
        ends = first[text + 1] - lo
        begins = np.flatnonzero(np.arange(len(part)) + window <= np.minimum(ends, len(part)))
        if not len(begins):
            continue
        spans = _Spans(part)
        g = spans.hash(np.arange(len(part) - gram + 1), np.arange(gram, len(part) + 1))
        least, width, wide = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), 1, window - gram + 1
        while 2 * width <= wide:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
        at = (least[begins] & _PLACE).astype(np.int64)
        turn = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (begins[1:] != begins[:-1] + 1)]))
        a, b = begins[turn], begins[np.concatenate([turn[1:], [len(begins)]]) - 1] + window
        base = first[text[a]] - lo
        yield text[a], a - base, b - base, g[at[turn]], spans.hash(a, b)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _marks(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            words, first = tokens.words(b.column(2), lower=False)
            for text, begin, end, g, s in segments(words, first, window, gram):
                yield pa.RecordBatch.from_arrays([_long(doc[text]), _long(key[text]), _long(g), _long(s), pa.array(begin.astype(np.int32)), pa.array((end - begin).astype(np.int32))], names=["doc_id", "h", "gram", "span", "at", "n"])

    return run


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of segments asked for: of a hot n-gram window by window, else each once a document with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            words, first = tokens.words(b.column(2), lower=False)
            spans = _Spans(words)
            asks = b.column(3)
            row = np.repeat(np.arange(len(asks)), np.diff(np.asarray(asks.offsets)))
            hot, query, gram, at, n = (asks.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("hot", "query", "gram", "at", "n"))
            begin = first[row] + at
            out: dict[tuple[int, int, int], list] = {}
            same = spans.hash(begin, begin + n)
            for k in np.flatnonzero(~hot).tolist():
                out.setdefault((int(row[k]), int(gram[k]), int(same[k])), [k, []])[1].append(int(at[k]))
            k = np.array([v[0] for v in out.values()], np.int64)
            if len(k):
                yield _sought(doc[row[k]], key[row[k]], gram[k], [v[1] for v in out.values()], query[k], [words[begin[i] : begin[i] + n[i]].view(np.int64) for i in k])
            k = np.flatnonzero(hot)
            if len(k):
                m = n[k] - window + 1
                k, step = np.repeat(k, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                a = begin[k] + step
                yield _sought(doc[row[k]], key[row[k]], spans.hash(a, a + window).view(np.int64), (at[k] + step)[:, None].tolist(), np.zeros(len(k), bool), [None] * len(k))

    return run


_SOUGHT = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("gram", pa.int64()), ("places", pa.list_(pa.int32())), ("query", pa.bool_()), ("words", pa.list_(pa.int64()))])


def _sought(doc, key, gram, places, query, words) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((doc, key, gram, places, query, words), _SOUGHT, strict=True)], schema=_SOUGHT)


def _search(window: int) -> Callable[[pa.Table], pa.Table]:
    """The repeated passages of the segments of one shard: doc_id, h, at, n."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("gram", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        column = lambda name: rows[name].combine_chunks() if rows[name].num_chunks != 1 else rows[name].chunk(0)
        words, doc = column("words"), column("doc_id").to_numpy()
        at = np.asarray(words.offsets).astype(np.int64)
        flat = words.flatten().to_numpy()
        at -= at[0]
        index = FMIndex(flat, at, doc)
        asked = np.flatnonzero(column("query").to_numpy(zero_copy_only=False))
        q = np.concatenate([[0], np.cumsum(np.diff(at)[asked])])
        pick = np.repeat(at[asked] - q[:-1], np.diff(q)) + np.arange(q[-1])
        text, begin, end = index.passages(flat[pick], q, doc[asked], window)
        text = asked[text]
        places = column("places")
        many = np.diff(np.asarray(places.offsets))
        start, place = np.asarray(places.offsets).astype(np.int64), places.flatten().to_numpy()
        start -= start[0]
        k = np.repeat(np.arange(len(text)), many[text])
        step = np.arange(len(k)) - np.repeat(np.cumsum(many[text]) - many[text], many[text])
        t = text[k]
        return pa.table({"doc_id": doc[t], "h": column("h").to_numpy()[t], "at": (place[start[t] + step] + begin[k]).astype(np.int32), "n": (end - begin)[k].astype(np.int32)})

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, at, n): n words from word at (0 is the first) of the texts with this id and hash that a smaller document holds; spans may overlap."""
    python_ready(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col).where("doc_id is not null and text is not null")
    marks = stored(rows.mapInArrow(_marks(window, gram), "doc_id long, h long, gram long, span long, at int, n int"))
    spans = stored(marks.groupBy("gram", "span").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    grams = spans.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"), F.min("low").alias("first"), F.max("high").alias("last"))
    grams = stored(grams.where("first < last").select("gram", "texts", "first"))
    # a segment that is the only text of its n-gram, or belongs to one document, has nothing else to say
    asked = stored(spans.join(grams, "gram").where("texts > 1 or low < high").select("gram", "span", "low", "texts", (F.col("low") > F.col("first")).alias("query")))
    hits = marks.join(asked, ["gram", "span"]).where("doc_id > low or texts > 1")
    hits = stored(hits.select("doc_id", "h", "at", "n", "gram", "query", (F.col("doc_id") > F.col("low")).alias("gone"), (F.col("texts") > HOT).alias("hot")))
    del marks, spans, asked, grams
    asks = hits.where("not gone").groupBy("doc_id", "h").agg(F.collect_list(F.struct("hot", "query", "gram", "at", "n")).alias("asks"))
    sought = stored(rows.join(asks, ["doc_id", "h"]).select("doc_id", "h", "text", "asks").mapInArrow(_cut(window), "doc_id long, h long, gram long, places array<int>, query boolean, words array<long>"))
    parts = sought.where("words is not null")
    shards = max(1, -(-(parts.agg(F.sum(F.size("words"))).first()[0] or 0) // SHARD_WORDS))
    found = parts.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards))).groupBy("shard").applyInArrow(_search(window), "doc_id long, h long, at int, n int")
    single = sought.where("words is null").select("doc_id", "h", "gram", F.col("places")[0].alias("at"))
    lows = stored(single.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("gram", "low"))
    later = single.join(lows, "gram").where("doc_id > low").select("doc_id", "h", "at", F.lit(window).alias("n"))
    return hits.where("gone").select("doc_id", "h", "at", "n").unionByName(found).unionByName(later)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, removed and kept of rows (doc_id, text, spans)."""
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        n_words, removed, kept = [], [], []
        for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            n_words.append(len(words))
            merged: list[dict] = []
            for s in sorted(spans or (), key=lambda s: s["at"]):
                if merged and s["at"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["at"] + s["n"])
                else:
                    merged.append({"begin": s["at"], "end": s["at"] + s["n"]})
            removed.append(merged)
            if merged:
                stay = np.ones(len(words), bool)
                for m in merged:
                    stay[m["begin"] : m["end"]] = False
                words = list(compress(words, stay.tolist()))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each input row: doc_id, n_words, removed (spans of words, begin and end, in order and apart) and kept, the other words joined by one space."""
    if not 0 < gram <= window:
        raise ValueError("an n-gram must fit into a window")
    found = repeated_passages(docs, id_col, text_col, window, gram)
    spans = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    rows = _keyed(docs, id_col, text_col).join(spans, ["doc_id", "h"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_strip, "doc_id long, n_words long, removed array<struct<begin: int, end: int>>, kept string")

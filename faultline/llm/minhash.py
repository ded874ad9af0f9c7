"""Near-duplicate texts by fast similarity sketching, banding and exact verification.

A text's set holds its distinct word shingles (A-Z lower-cased; a shorter text is one shingle
as a whole). A sketch has `bands * rows` coordinates. In round i each element of the set is
thrown into one coordinate, with a value of i plus a hash; a coordinate keeps its least value.
Rounds go on until each coordinate holds a value; after as many rounds as there are coordinates,
round t + j throws all elements into coordinate j, so every coordinate fills whatever the set.
Coordinates of two sets agree with the probability of the sets' Jaccard similarity, as tightly
concentrated as full MinHash, while a set of n elements costs O(n + t log t).

Texts that agree in all rows of a band meet in a bucket. A bucket names its smallest class
as its hub, and all classes that share a hub form a cluster, which holds every pair that
meets in any bucket of that hub. A cluster is cut into blocks of bounded weight. Each block is
one task, which compares whole sets exactly and returns links that span the components it found,
never all pairs; the hub is in all blocks, so the blocks of a dense group meet through it. Only
the members that their block did not link to the hub are then compared with all other blocks: of
two members that a block did link to it, nothing is left to learn. With 32 bands of 5 rows a
pair at 0.85 is missed by all bands with probability 7e-9.

Exact copies meet first: a class holds all rows whose whole sets have the same 128-bit digest,
and only one text of each class that shares a bucket takes part in the rest. Classes are numbered when they are stored.

Defined results:
- null or empty texts and texts without words: n_shingles 0, linked with nothing, own component;
- null ids: a row stays, judged by its text, and its own id takes no part in the minimum; with no
  other id to name, component_id is null and kept is true;
- repeated rows: each gets the result of its text's class; kept is true for each copy of the
  row that holds the smallest id (`one_of_each` then takes one of them);
- rows that repeat an id with other texts: each is judged by its own text;
- other columns, whatever their names, are ignored (`one_of_each` carries them along); an empty
  table gives an empty result;
- very long texts are hashed in segments and weigh more when clusters are cut into blocks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import BROADCAST_IDS, components, python_ready, stored

#: Shingles that a block of a cluster holds, apart from a single larger text.
BLOCK_SHINGLES = 200_000
#: Stands for a null id in orders and joins: after all others.
_LAST = (1 << 63) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array | pa.ChunkedArray, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    h, at = tokens.words(column)
    n, out = len(h), []
    whole = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words):
        whole += tokens.mix(h[j : n - words + 1 + j] + np.uint64(j + 1)) * (_GOLD + np.uint64(2 * j)) if n >= words else whole
    whole = tokens.mix(whole)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:  # fewer words: their sequence is the only shingle
            one = np.array([b - a], np.uint64)
            for k in range(a, b):
                one = tokens.mix(one * _GOLD + h[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a set: sorted distinct hashes, at least one."""
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    x = np.asarray(elements, np.uint64)
    i, n = 0, len(x)
    while i < t and empty.any():
        rounds = int(min(t - i, max(1, 4 * t // n)))
        seeds = np.arange(i, i + rounds, dtype=np.uint64)[:, None] * _GOLD
        h = tokens.mix(x[None, :] ^ tokens.mix(seeds + np.uint64(1)))
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        for k in range(rounds):  # a later round's values are larger: only empty coordinates take one
            b, v = bins[k].astype(np.int64), h[k]
            new = empty[b]
            if new.any():
                b, v = b[new], v[new]
                order = np.lexsort((v, b))
                first = np.concatenate([[True], b[order][1:] != b[order][:-1]])
                at = b[order][first]
                out[at] = tokens.mix(v[order][first] + np.uint64(i + k))
                empty[at] = False
                if not empty.any():
                    break
        i += rounds
    for j in np.flatnonzero(empty):
        v = tokens.mix(x ^ tokens.mix(np.array([t + j], np.uint64) * _GOLD))
        out[j] = tokens.mix(np.array([v.min() + np.uint64(t + j)], np.uint64))[0]
    return out


def band_keys(elements: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of the set's sketch; the band's number is part of it."""
    s = sketch(elements, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for j in range(rows):
        key = tokens.mix(key + s[:, j])
    return key


def _signatures(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    @functools.lru_cache(maxsize=64)
    def same(raw: bytes) -> np.ndarray:
        return band_keys(np.frombuffer(raw, np.uint64), bands, rows).view(np.int64)

    for batch in batches:
        sets = shingle_sets(batch.column(1), words)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        found = [same(s.tobytes()) if len(s) else np.zeros(0, np.int64) for s in sets]
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        values = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at), values)],
            names=["doc_id", "h", "n_shingles", "digest", "bands"],
        )


def spanning_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of exact similarity >= percent / 100.

    side: 0 and 1 if only links across the two sides matter, else all the same. A member
    that already belongs to the largest component found is put off. In the end those put off
    are compared too, but for the ones that lie in one and the same component: a link between
    two of these adds nothing, and every other link has an end that met all members.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    runs = np.diff(np.concatenate([begins, [len(values)]]))
    run_of = np.empty(len(order), np.int64)
    run_of[order] = np.repeat(np.arange(len(begins)), runs)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    root, weight = np.arange(n), np.ones(n, np.int64)
    links: list[tuple[int, int]] = []

    def meet(i: int) -> None:
        """Compares member i with all members of other components."""
        mine = run_of[starts[i] : starts[i + 1]]
        mine = mine[runs[mine] > 1]
        if not len(mine):
            return
        length = runs[mine]
        offset = np.repeat(begins[mine] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        common = np.bincount(owner[offset + np.arange(int(length.sum()))], minlength=n)
        hit = 100 * common >= percent * (sizes + sizes[i] - common)
        hit &= root != root[i]
        for j in np.flatnonzero(hit).tolist():
            a, b = int(root[i]), int(root[j])
            if a != b and (side[i] != side[j] or side[0] == side[-1]):
                links.append((i, j))
                if weight[a] < weight[b]:
                    a, b = b, a
                root[root == b] = a
                weight[a] += weight[b]
                weight[b] = 0

    off: list[int] = []
    for i in np.argsort(-np.add.reduceat(runs[run_of], starts[:-1]), kind="stable").tolist():
        top = int(weight.argmax())
        if root[i] == top and weight[top] > 1:
            off.append(i)
        else:
            meet(i)
    if off:
        exempt = off[int(np.bincount(root[off], minlength=n)[root[off]].argmax())]
        for i in off:
            if root[i] != root[exempt]:
                meet(i)
    return links


def _links(percent: int, words: int):
    """Compares a block of a cluster in itself; of a cut cluster it also names (b null) the members that it does not link to the hub."""

    def compare(rows: pa.Table) -> pa.Table:
        node, hub = rows["node"].to_pylist(), rows["hub"][0].as_py()
        sets = shingle_sets(rows["text"], words)
        found = spanning_links(sets, np.zeros(len(sets), int), percent) if len(sets) > 1 else []
        out = [(node[i], node[j]) for i, j in found]
        if max(rows["k"].to_pylist()) > 1:
            root = np.arange(len(sets))
            for i, j in found:
                root[root == root[j]] = root[i]
            home = root[node.index(hub)]
            out += [(node[i], None) for i in np.flatnonzero(root != home)]
        return pa.table([[hub] * len(out), [a for a, _ in out], [b for _, b in out]], schema=pa.schema([(x, pa.int64()) for x in ("hub", "a", "b")]))

    return compare


def _cross_links(percent: int, words: int):
    """Links between the members that no block linked to the hub (`lone`) and a block of the cluster."""

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("lone")
        node, side = rows["node"].to_pylist(), np.array(rows["lone"].to_pylist(), int)
        found = spanning_links(shingle_sets(rows["text"], words), side, percent) if side.min() < side.max() else []
        return pa.table([[node[i] for i, _ in found], [node[j] for _, j in found]], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return compare


def _few(rows: DataFrame) -> DataFrame:
    """rows, marked for a broadcast if they are no more than BROADCAST_IDS."""
    return F.broadcast(rows) if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else rows


def _cluster_links(classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that span the components of classes(node, n, bands, at); texts has `at` and text, for some of them several times."""
    spread = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("bucket", "hub")
    pairs = spread.join(hubs, "bucket").select("hub", "node").distinct()
    members = stored(pairs.join(classes.select("node", "n", "at"), "node"))

    def with_texts(rows: DataFrame) -> DataFrame:
        """rows with the text of their `at`; only texts that are asked for are shuffled, and those that are alike meet before."""
        asked = _few(rows.select("at").distinct())
        return rows.join(texts.join(asked, "at", "left_semi").groupBy("at").agg(F.first("text").alias("text")), "at")

    # only clusters that do not fit one block are looked up; they are few, and more than can be broadcast are joined by a shuffle
    big = stored(members.groupBy("hub").agg(F.sum("n").alias("weight")).where(F.col("weight") > BLOCK_SHINGLES).select(F.col("hub").alias("__big"), F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int").alias("k")))
    some = not big.isEmpty()
    sized = members.join(_few(big), F.col("hub") == F.col("__big"), "left") if some else members.withColumn("k", F.lit(None).cast("int"))
    sized = sized.select("hub", "node", "n", "at", F.coalesce("k", F.lit(1)).alias("k"))
    # the hub is a member of every block of its cluster
    blocks = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("k")).cast("int")))
    first = with_texts(sized.select("hub", "node", "at", "k", F.explode(blocks).alias("i")))
    found = first.select("hub", "i", "node", "k", "text").groupBy("hub", "i").applyInArrow(_links(percent, words), "hub long, a long, b long")
    if not some:
        return found.select("a", "b")
    found = stored(found)
    lone = stored(found.where("b is null").select("hub", F.col("a").alias("node")).distinct().join(sized, ["hub", "node"]))
    again = stored(lone.groupBy("hub").agg(F.sum("n").alias("weight")).select(F.col("hub").alias("__lone"), F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int").alias("m")))
    found = found.where("b is not null").select("a", "b")
    if again.isEmpty():
        return found
    many = _few(again)
    part = lambda x: F.pmod(F.xxhash64("node"), F.col(x)).cast("int")
    left = lone.join(many, F.col("hub") == F.col("__lone")).select("hub", "node", "at", part("m").alias("p"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), F.lit(True).alias("lone"))
    right = sized.join(many, F.col("hub") == F.col("__lone")).select("hub", "node", "at", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("p"), part("k").alias("i"), F.lit(False).alias("lone"))
    crossed = with_texts(left.unionByName(right)).select("hub", "p", "i", "node", "lone", "text")
    return found.unionByName(crossed.groupBy("hub", "p", "i").applyInArrow(_cross_links(percent, words), "a long, b long"))


def _row_key(id_col: str, text_col: str) -> Column:
    """A number of a row's id and text: equal rows have equal ones."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """One row for each input row: doc_id, h (its row key), n_shingles, node (its class, null without words), component (a node), component_id."""
    python_ready(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", _row_key("doc_id", "text"))
    found = stored(texts.select("doc_id", "text", "h").mapInArrow(lambda it: _signatures(it, words, bands, rows), "doc_id long, h long, n_shingles long, digest binary, bands array<long>"))
    at = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "h")
    classes = found.where("digest is not null").groupBy("digest").agg(F.min(at).alias("at"), F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    links = components(_cluster_links(classes, texts.select(at.alias("at"), "text"), words, percent))
    named = stored(classes.select("digest", "low", "node").join(links, "node", "left").select("digest", "low", F.coalesce("component", "node").alias("component")))
    # stored apart, so that an adaptive join may split the members of a large component
    lows = stored(named.groupBy("component").agg(F.min("low").alias("component_id")))
    named = named.join(lows, "component").select(F.col("digest").alias("key"), "component", "component_id")
    # rows without words have no class: each gets a key of its own, so they do not meet in one task
    key = F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("doc_id", "h")).cast("binary"))
    out = found.select("doc_id", "h", "n_shingles", "digest", key.alias("key")).join(named, "key", "left")
    return out.select("doc_id", "h", "n_shingles", F.col("digest").alias("node"), "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id and kept.

    id_col holds integers. See the module for the method and for unusual input.
    """
    out = _grouped(docs, id_col, text_col, words, percent, bands, rows)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull() & component.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row, with all columns, of each group of near copies: the one with the smallest id, then the smallest hash of id and text.

    Rows are judged by their texts, so rows that share an id but not a text may both stay. Of rows that repeat both
    id and text one stays; rows without an id are passed over if their group has others. Rows without words are all
    kept, but for repeats of the same id and text.
    """
    marks = _grouped(docs, id_col, text_col, words, percent, bands, rows)
    whole = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "h")
    ids = stored(marks.groupBy("doc_id", "h").agg(F.first("component").alias("component"), (F.count(F.lit(1)) > 1).alias("many")))
    best = ids.where("component is not null").groupBy(F.col("component").alias("node")).agg(F.min(whole).alias("best"))
    alone = ids.where("component is null").select(whole.alias("best"))
    stays = best.select("best").unionByName(alone).select(F.col("best.doc_id").alias("__doc"), F.col("best.h").alias("__at"))
    packed = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("__doc"), _row_key(id_col, text_col).alias("__at"))
    if not ids.where("many").isEmpty():  # rows that are alike meet before the shuffle
        packed = packed.groupBy("__doc", "__at").agg(F.first("__row").alias("__row"))
    return packed.join(stays, ["__doc", "__at"]).select("__row.*")

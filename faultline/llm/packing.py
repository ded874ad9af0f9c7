"""Variable-capacity best-fit packing of documents into training sequences.

Items go into bins in the order of falling length, each into the open bin with the least room
that still holds it. If none does, a bin is opened in the permitted size whose cost for each
token is least, given how many items of this length and how many tokens of shorter items are
left to fill it. At the end each bin is cut down to the smallest permitted size that holds
its contents.

Only lengths decide, and no length exceeds the largest size, so the whole corpus is packed
exactly from its histogram of lengths: bins that are alike are handled as ranges of bin
numbers, and the plan says which ranks of a length go to which bins at which offset. Its size
depends on the permitted sizes, not on the corpus: a range ends a length's items or the bins of one room,
so there are at most about half the square of the largest size of them, in practice some thousands.

Pieces that are alike (id, text, piece) are counted first. Pieces find their rank within their length by blocks
of a hash, first the counts of blocks, then running sums within one, so a length that a third of all
rows have is spread over `blocks` tasks; they look their bin up in the broadcast plan. Counted pieces
are told apart again by `copy`, CHUNK at a time.

An item longer than the largest size is cut into pieces of that size and a remainder.

Defined results:
- null or empty text, no tokens: one row with n_tokens 0 and no bin (null bin_id, bin_offset, capacity, bin_tokens);
- null ids: packed like others; repeated rows are packed each, numbered by copy; ties in length go by a hash, then
  doc_id, text and piece;
- other columns are ignored; an empty table gives an empty result; long texts are cut, never dropped.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, stored, words_of

SIZES = (512, 1024, 2048, 4096)
OVERHEAD, BLOCKS = 16, 1024
#: Copies of one piece that a task tells apart.
CHUNK = 100_000


def plan_bins(counts: dict[int, int], sizes: Sequence[int] = SIZES, overhead: float = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """Ranges (length, first rank, items, first bin, offset), and bins (first bin, bins, capacity, tokens), from counts by length."""
    sizes, top = sorted(sizes), max(sizes)
    assert all(0 < n <= top for n in counts), "lengths lie between 1 and the largest size"
    open_: dict[int, list[list[int]]] = {}  # room -> ranges [first bin, bins, opened size]
    rooms: list[int] = []
    ranges, bins, closed = [], 0, []
    rest = sum(n * c for n, c in counts.items())

    def put(room: int, entry: list[int]) -> None:
        if room == 0:
            closed.append((entry[0], entry[1], entry[2], entry[2]))
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append(entry)

    def fitting(size: int) -> int:
        return sizes[bisect.bisect_left(sizes, size)]

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        rest -= length * left  # tokens of the shorter items
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n, size = open_[room][0]
                # a bin that took one item has less room than its like, so it takes the next as well while it can
                each = min(room // length, left)
                m = min(n, left // each)
                if m == n:
                    open_[room].pop(0)
                    if not open_[room]:
                        del open_[room], rooms[k]
                else:
                    open_[room][0] = [first + m, n - m, size]
                for j in range(each):
                    ranges.append((length, rank, m, first, size - room + j * length))
                    rank, left = rank + m, left - m
                put(room - each * length, [first, m, size])
                continue

            def cost(size: int) -> float:
                own = min(left, size // length) * length
                fill = own + min(size - own, rest)
                return (fitting(fill) + overhead) / fill

            size = min((s for s in sizes if s >= length), key=cost)
            each = size // length
            whole = max(1, left // each)
            each = min(each, left)
            for j in range(each):  # layer j of the new bins
                ranges.append((length, rank, whole, bins, j * length))
                rank, left = rank + whole, left - whole
            put(size - each * length, [bins, whole, size])
            bins += whole
    for room, entries in open_.items():
        closed += [(first, n, fitting(size - room), size - room) for first, n, size in entries]
    return np.array(sorted(ranges), np.int64).reshape(-1, 5), np.array(sorted(closed), np.int64).reshape(-1, 4)


def pack(items: DataFrame, sizes: Sequence[int] = SIZES, overhead: float = OVERHEAD, blocks: int = BLOCKS) -> DataFrame:
    """One row for each piece of the items (doc_id, n_tokens, key): doc_id, key, piece, copy, pieces, n_tokens, bin_id, bin_offset, capacity, bin_tokens.

    key: a number that tells items of one id apart, for example a hash of the text; 0 if items have none.
    """
    python_ready(items.sparkSession)
    top = max(sizes)
    tokens = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("all")
    rows = items.select(F.col("doc_id").cast("long"), (F.col("key") if "key" in items.columns else F.lit(0)).cast("long").alias("key"), tokens)
    rows = rows.withColumn("pieces", F.greatest(F.ceil(F.col("all") / top), F.lit(1)).cast("long"))
    each = rows.select("doc_id", "key", "all", "pieces", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    each = each.select("doc_id", "key", "piece", "pieces", F.least(F.col("all") - F.col("piece") * top, F.lit(top)).alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(blocks)).cast("int").alias("block"))
    alike = ("n_tokens", "block", "doc_id", "key", "piece", "pieces")
    pieces = stored(each.groupBy(*alike).agg(F.count(F.lit(1)).alias("copies")))
    counts = pieces.where("n_tokens > 0").groupBy("n_tokens", "block").agg(F.sum("copies").alias("n"))
    earlier = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counts.withColumn("before", earlier("n", "n_tokens", ["block"])))
    # at most as many rows as the largest size
    histogram = {int(r["n_tokens"]): int(r["n"]) for r in offsets.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    ranges, bins = plan_bins(histogram, sizes, overhead)
    shared = pieces.sparkSession.sparkContext.broadcast((ranges, bins))
    ranked = pieces.where("n_tokens > 0").withColumn("rank", earlier("copies", "n_tokens", "block", ["doc_id", "key", "piece"])).join(offsets.drop("n"), ["n_tokens", "block"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).unionByName(pieces.where("n_tokens = 0").withColumns({"rank": F.lit(None).cast("long"), "before": F.lit(None).cast("long")}))
    ranked = ranked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))))
    if not pieces.where(F.col("copies") > CHUNK).isEmpty():
        ranked = ranked.repartition("n_tokens", "block", "doc_id", "key", "piece", "chunk")
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("chunk") * CHUNK + CHUNK, F.col("copies")) - 1)))
    ranked = ranked.select("doc_id", "key", "piece", "copy", "pieces", "n_tokens", (F.col("rank") + F.col("copy")).alias("rank"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, bins = shared.value
        keys = (ranges[:, 0] << 40) + ranges[:, 1]
        for b in batches:
            length, rank = b.column(5).to_numpy(), b.column(6).fill_null(0).to_numpy()
            none = length == 0
            columns = [np.zeros(len(length), np.int64)] * 4
            if len(ranges):
                r = ranges[np.maximum(np.searchsorted(keys, (length << 40) + rank, "right") - 1, 0)]
                at = r[:, 3] + rank - r[:, 1]
                k = bins[np.maximum(np.searchsorted(bins[:, 0], at, "right") - 1, 0)]
                columns = [at, r[:, 4], k[:, 2], k[:, 3]]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *[pa.array(c, pa.int64(), mask=none) for c in columns]], names=PACKED)

    return ranked.mapInArrow(look_up, ", ".join(f"{c} long" for c in PACKED))


PACKED = ["doc_id", "key", "piece", "copy", "pieces", "n_tokens", "bin_id", "bin_offset", "capacity", "bin_tokens"]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_text: bool = False, **options) -> DataFrame:
    """pack() of whole documents, counted in words, or in tokens of the `tokenizers` file at the path `tokenizer`.

    with_text: also `text`, the whole text of a document in one piece, and of the pieces of a longer one their words, joined by
    spaces; only where words are counted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    if tokenizer is None:
        packed = pack(rows.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens")), **options)
        return _texts(packed, rows, max(options.get("sizes", SIZES))) if with_text else packed
    if with_text:
        raise ValueError("pieces of text are cut by words: leave out the tokenizer or the texts")
    with open(tokenizer) as f:  # read by the driver, sent along with the tasks
        model = f.read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model)
        t.encode_special_tokens = True
        for b in batches:
            n = [len(e.ids) for e in t.encode_batch(b.column(1).fill_null("").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "key", "n_tokens"])

    return pack(rows.mapInArrow(count, "doc_id long, key long, n_tokens long"), **options)


def _texts(packed: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """packed with the text of each piece; rows that are alike meet before the shuffle, so each text travels once."""
    none = (1 << 63) - 1
    one = rows.select(F.coalesce("doc_id", F.lit(none)).alias("__id"), F.col("key").alias("__key"), "text").groupBy("__id", "__key").agg(F.first("text").alias("text"))
    out = packed.withColumns({"__id": F.coalesce("doc_id", F.lit(none)), "__key": F.col("key")}).join(one, ["__id", "__key"], "left")
    words = F.array_join(F.slice(words_of(F.col("text")), (F.col("piece") * top + 1).cast("int"), top), " ")
    return out.select(*PACKED, F.when(F.col("pieces") == 1, F.col("text")).otherwise(words).alias("text"))


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each bin: bin_id, capacity, bin_tokens and its pieces in order (no more than its capacity)."""
    each = F.struct("bin_offset", "doc_id", "key", "piece", "copy", "n_tokens")
    return packed.where("bin_id is not null").groupBy("bin_id", "capacity", "bin_tokens").agg(F.array_sort(F.collect_list(each)).alias("pieces"))

"""Quality rules: repetition and length rules, then a hashed n-gram log-likelihood ratio.

The base rules count words, word characters, symbols, repeated lines and words in repeated
5-word windows. The method compares two multinomials over hashed word unigrams and bigrams,
one of a trusted target and one of the whole raw corpus, both counted over all of their
texts: every bucket holds ln(p_target / p_raw), in millionths of a nat, and a document's
score is the sum over its n-grams divided by their number. A document is kept if it passes
the base rules and its score reaches a fixed threshold; sums are whole numbers, so the
verdict is the same in every run and at every partitioning.

Everything is built from SQL expressions. The table of buckets is one array of bounded
length (BUCKETS numbers of 8 bytes), a scalar subquery whose result goes to the scoring tasks
once; as a joined column it would be copied for every document.

Defined results:
- null and empty texts: counts of 0, base_failed true, kept false, score 0;
- one word: no bigram; an empty target or corpus: every score is 0;
- null ids: the row stays and is never part of the target;
- repeated rows each get their result and each count in the corpus; other columns are ignored;
- an empty table gives an empty result; very long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flagged, let, words_of

BUCKETS = 1 << 18
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Mean millionths of a nat for each n-gram below which a document is rejected.
THRESHOLD_MICRO = -200_000
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_codes(words: Column) -> Column:
    """A 32-bit code of each word."""
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def _zipped(a: Column, b: Column, skip: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of each entry of a and the entry of b that many places further on, as far as both go."""
    n = F.greatest(F.least(F.size(a), F.size(b) - skip), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, skip + 1, n), f)


def pair_codes(codes: Column) -> Column:
    return _zipped(codes, codes, 1, lambda a, b: a * 65599 + b * 40503)


def ngram_buckets(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, trusted) of every word unigram and bigram of rows (text, trusted); buckets is a power of two.

    Words become rows before they are hashed, as rows go through generated code and the entries of arrays do not.
    """
    code = lambda w: F.crc32(w.cast("binary"))
    split = rows.select("trusted", words_of(F.col("text")).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    coded = split.select("trusted", F.explode(pairs).alias("x")).select("trusted", code(F.col("x.a")).alias("a"), code(F.col("x.b")).alias("b"))
    both = F.array(F.col("a").bitwiseAND(buckets - 1), F.shiftright(F.col("a") * 65599 + F.col("b") * 40503, 9).bitwiseAND(buckets - 1))
    return coded.select("trusted", F.explode(both).alias("bucket")).where("bucket is not null")


def repeated_words(words: Column, codes: Column, pairs: Column, window: int = 5) -> Column:
    """How many words lie in a window of five words that occurs twice or more in the array.

    Equal codes of windows are looked for first; only texts that hold some compare the windows themselves.
    """
    assert window == 5, "windows are coded as two pairs and a word"
    fours = _zipped(pairs, pairs, 2, lambda a, b: F.shiftleft(a, 15).bitwiseXOR(b))
    fives = let(fours, lambda x: _zipped(x, codes, 4, lambda a, c: F.shiftleft(a, 5).bitwiseXOR(c)))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
        return F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i, window)).alias("w"), i.alias("i"))))

    distinct = let(fives, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) <= window, 0).when(distinct, 0).otherwise(let(words, lambda w: let(windows(w), lambda s: _covered(s, window))))


def _covered(sorted_windows: Column, window: int) -> Column:
    """From sorted (window, start) pairs: the number of positions that windows with an equal neighbour cover."""

    def count(texts: Column, at: Column) -> Column:
        same = let(_zipped(texts, texts, 1, lambda a, b: a == b), lambda x: F.zip_with(F.concat(x, F.array(F.lit(False))), F.concat(F.array(F.lit(False)), x), lambda a, b: a | b))
        starts = F.sort_array(F.array_compact(F.zip_with(same, at, lambda hit, i: F.when(hit, i))))
        return let(starts, lambda x: F.when(F.size(x) == 0, 0).otherwise(F.aggregate(_zipped(x, x, 1, lambda a, b: F.least(F.lit(window), b - a)), F.lit(window), lambda n, g: n + g)))

    return let(F.transform(sorted_windows, lambda x: x["w"]), lambda texts: let(F.transform(sorted_windows, lambda x: x["i"]), lambda at: count(texts, at)))


def base_measures(text: Column, words: Column, codes: Column, pairs: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long."""
    safe = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(safe, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    extra = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(safe, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": extra.cast("long"),
        "n_repeat_words": repeated_words(words, codes, pairs).cast("long"),
    }


def ratio_table(grams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with `ratio`, an array of millionths of a nat by bucket, from rows of (bucket, trusted).

    Both multinomials have one added to each bucket of the smaller and, in proportion, to each of the larger,
    so that an n-gram seen nowhere scores 0.
    """
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("target"))
    each = grams.sparkSession.range(buckets).join(counts, F.col("id") == F.col("bucket"), "left").select("id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    # one row of as many small entries as there are buckets, whatever the corpus
    whole = each.agg(F.sum("raw").cast("double").alias("n_raw"), F.sum("target").cast("double").alias("n_target"), F.sort_array(F.collect_list(F.struct("id", "raw", "target"))).alias("all"))
    add = F.try_divide("n_raw", "n_target")

    def value(x: Column) -> Column:
        target = F.ln((x["target"] + 1.0) / (F.col("n_target") + float(buckets)))
        return F.when(F.col("n_target") > 0, F.round(1e6 * (target - F.ln((x["raw"] + add) / (F.col("n_raw") + add * float(buckets)))))).otherwise(0.0).cast("long")

    return whole.select(F.transform("all", value).alias("ratio"))


def scored(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_micro: int = THRESHOLD_MICRO, buckets: int = BUCKETS) -> DataFrame:
    """`row` (a struct of all columns of docs) with `quality`, a struct of all results; see quality_rules."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    grams = ngram_buckets(flagged(rows, trusted_ids, "doc_id", "trusted"), buckets)
    ratio = ratio_table(grams, buckets).scalar()
    text = F.col("text")

    # one nested expression: a filter on it can be moved about without computing any part of it twice
    def result(w: Column, c: Column, p: Column, table: Column) -> Column:
        measures = F.struct(*[x.alias(k) for k, x in base_measures(text, w, c, p).items()])
        # each word with the pair that starts at it; the last word starts none
        weights = F.zip_with(c, p, lambda h, q: F.get(table, h.bitwiseAND(buckets - 1)) + F.coalesce(F.get(table, F.shiftright(q, 9).bitwiseAND(buckets - 1)), F.lit(0).cast("long")))
        total = F.aggregate(weights, F.lit(0).cast("long"), lambda a, x: a + x)
        return let(F.struct(measures.alias("m"), (F.size(c) + F.size(p)).cast("long").alias("n"), total.alias("t")), verdict)

    def verdict(x: Column) -> Column:
        m = x["m"]
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        kept = ~failed & (x["t"] >= threshold_micro * x["n"])
        return F.struct(*[m[k].alias(k) for k in MEASURES], failed.alias("base_failed"), kept.alias("kept"), x["n"].alias("n_grams"), x["t"].alias("score_micro"))

    quality = let(F.col("ratio"), lambda table: let(words_of(text), lambda w: let(word_codes(w), lambda c: let(pair_codes(c), lambda p: result(w, c, p, table)))))
    # read once, so the optimizer puts the subquery itself in the place of the column
    return docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text")).withColumn("ratio", ratio).select("row", quality.alias("quality"))


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: doc_id, the base measures, base_failed, kept, n_grams, score_micro.

    trusted_ids: one column of ids; the texts of these documents are the target.
    score_micro: millionths of a nat, summed over the n-grams.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(narrow, trusted_ids, **options).select("row.doc_id", "quality.*")


def keep_good(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps."""
    return scored(docs, trusted_ids, **options).where("quality.kept").select("row.*")

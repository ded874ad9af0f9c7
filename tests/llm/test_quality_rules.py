import math
import random
import re
import zlib
from collections import Counter

from faultline.llm import quality_rules as q

SF = "/root/testdata/sf0.01"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = [w for w in GAP.split(text) if w]
    lines = [x for x in text.split("\n") if GAP.sub("", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def grams(text, buckets):
    codes = [zlib.crc32(w.encode()) for w in GAP.split(text or "") if w]
    return [c % buckets for c in codes] + [((a * 65599 + b * 40503) >> 9) % buckets for a, b in zip(codes, codes[1:], strict=False)]


def brute(rows, trusted, buckets):
    raw, target = Counter(), Counter()
    for k, t in rows:
        g = grams(t, buckets)
        raw.update(g)
        if k in trusted:
            target.update(g)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    add = n_raw / n_target if n_target else 0
    value = [0] * buckets
    for b in range(buckets) if n_target else []:
        value[b] = round(1e6 * (math.log((target[b] + 1) / (n_target + buckets)) - math.log((raw[b] + add) / (n_raw + add * buckets))))
    return [(k, *base(t), sum(value[g] for g in grams(t, buckets)), len(grams(t, buckets))) for k, t in rows]


def check(spark, rows, trusted, buckets):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS words", "1 AS bucket", "true AS kept")
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = q.quality_rules(docs, ids, buckets=buckets).collect()
    want = brute(rows, set(trusted), buckets)
    key = lambda r: str(r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([w[:6] for w in want], key=key)
    sums = {r.doc_id: (r.score_micro, r.n_grams, r.base_failed, r.kept) for r in got}
    for k, n, *rest in want:
        repeat, total, grams_ = rest[-3], rest[-2], rest[-1]
        score, n_grams, failed, kept = sums[k]
        assert n_grams == grams_ and abs(score - total) <= n_grams  # the logarithm's last digit may round apart
        assert failed == (n < 10 or 100 * repeat > 20 * n)
        assert kept == (not failed and score >= q.THRESHOLD_MICRO * n_grams)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0")  # a small fixture
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    good = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()]
    check(spark, rows, good, 1 << 12)


def test_unusual_input(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d e a b c d e a b c d e"), (6, long), (7, "x\nx\n\nx\ny | # <b>"), (None, "q r s t u v w x y z q r s t u v w x y z")]
    check(spark, rows, [5, 7], 256)
    check(spark, rows, [], 256)
    assert q.quality_rules(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).count() == 0


def test_keep_good_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", "s", 7), (1, "a b c d e f g h i j k l", "s", 8), (2, "short", None, 9)], "doc_id long, text string, ratio string, quality int")
    got = q.keep_good(docs, spark.createDataFrame([(1,)], "doc_id long"))
    assert got.columns == docs.columns and sorted(r.quality for r in got.collect()) == [7, 8]


def test_buckets_tell_junk_from_a_large_vocabulary(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(f"{'good' if k % 2 else 'junk'}{rng.randrange(20_000)}" for _ in range(60))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(k,) for k in range(1, 3000, 4)], "doc_id long")
    got = q.quality_rules(docs, ids).collect()
    assert not any(r.base_failed for r in got)
    assert sum(r.kept for r in got if r.doc_id % 4 == 3) >= 740  # of 750 good ones that are not in the target
    assert sum(r.kept for r in got if r.doc_id % 2 == 0) <= 15  # of 1500

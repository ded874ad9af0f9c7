"""The whole pipeline against plain Python: quality rules, near copies, secrets, mixture and packing."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import test_operators
import test_quality_rules
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import minhash, mixing, packing, quality_rules, secret_scan

SF = "/root/testdata/sf0.001"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def quality(rows, trusted):
    out = test_quality_rules.brute([(r[0], r[1]) for r in rows], trusted, quality_rules.BUCKETS)
    kept = []
    for r, (_, n, _, _, _, repeat, total, grams) in zip(rows, out, strict=True):
        if n >= 10 and 100 * repeat <= 20 * n and total >= quality_rules.THRESHOLD_MICRO * grams:
            kept.append(r)
    return kept


def one_of_each(rows):
    rows = list(dict.fromkeys(rows))
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        k = find(i)
        rank = math.inf if r[0] is None else r[0]
        if k not in best or rank < best[k][0]:
            best[k] = (rank, i)
    return [rows[i] for _, i in best.values()]


def spans(text):
    base = []
    for pattern, least in ((r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), (r"(AKIA[A-Z0-9]+)", 20), (r"([0-9a-f]+)", 24)):
        base += [(m.start(), m.end(), m[1]) for m in re.finditer(pattern, text or "") if len(m[1]) >= least]
    extra = [(m.start(), m.end(), m[1]) for m in re.finditer(r"((?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ)[A-Za-z0-9_.-]+)", text or "") if len(m[1]) >= 20]
    extra += [(m.start(), m.end(), m[1]) for m in re.finditer(r"([A-Za-z0-9+/_=-]+)", text or "") if len(m[1]) >= 24 and all(re.search(p, m[1]) for p in ("[A-Z]", "[a-z]", "[0-9]"))]
    return base, [x for x in extra if not any(b[0] < x[1] and x[0] < b[1] for b in base)]


def redacted(rows):
    owners = {}
    for r in rows:
        for x in sum(spans(r[1]), []):
            owners.setdefault(x[2], set()).add((r[2] or "").split("/")[0])
    out = []
    for r in rows:
        base, extra = spans(r[1])
        text, at, clean = r[1], 0, ""
        for s, e, _ in sorted(base + [x for x in extra if len(owners[x[2]]) <= 1]):
            if s >= at:
                clean += text[at:s] + "<secret>"
            at = max(at, e)
        out.append((r[0], text if not clean and at == 0 else clean + text[at:], r[2]))
    return out


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def mixture(rows, most=mixing.MAX_REPEATS):
    total = Counter()
    for r in rows:
        total[r[2]] += len(words(r[1]))
    logs = [math.log(t) for t in total.values() if t]
    if not logs:
        return rows
    lo, hi = 0.0, 1.0
    for _ in range(mixing.HALVINGS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if math.exp((max(logs) - min(logs)) * (1 - mid)) <= most else (mid, hi)
    a = 0.0 if math.exp(max(logs) - min(logs)) <= most else hi
    out = []
    for source, t in total.items():
        quota = math.floor(math.exp((max(logs) - math.log(t)) * (1 - a)) * t + 0.5) if t else 0
        full, rest = divmod(quota, t) if t else (1, 0)
        mine = []
        for r in (r for r in rows if r[2] == source):
            key = md5("" if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).hexdigest())
            mine.append((md5("block", full, key[: mixing.BLOCK_DIGITS]), md5("row", full, key), r))
        start = 0
        for _, _, r in sorted(mine, key=lambda x: x[:2]):
            out += [r] * (full + (start < rest))
            start += len(words(r[1]))
    return out


def check(spark, folder, rows, trusted):
    want = mixture(redacted(one_of_each(quality(rows, trusted))))
    got = corpus_pipeline.run(spark, folder).collect()
    top = max(packing.SIZES)
    pieces, lengths = Counter(), []
    for r in want:
        w = words(r[1])
        for i in range(max(1, -(-len(w) // top))):
            part = w[i * top : i * top + top]
            pieces[(r[0], i, len(part), r[1] if len(w) <= top else " ".join(part))] += 1
            lengths += [len(part)] if part else []
    assert Counter((r.doc_id, r.piece, r.n_tokens, r.text) for r in got) == pieces
    assert len({(r.doc_id, r.key, r.piece, r["copy"]) for r in got}) == len(got)
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert {r.bin_tokens for r in rs} == {at}
    assert sorted((rs[0].capacity, rs[0].bin_tokens) for rs in bins.values()) == test_operators.naive_packing(lengths, sorted(packing.SIZES), packing.OVERHEAD)
    return got


def test_run_on_whole_documents(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(check(spark, SF, rows, trusted)) > 100


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_odd_rows(spark, tmp_path, empty):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows = [(k, text(40), f"s{k % 3}") for k in range(30)] + [(50 + k, text(30), None) for k in range(4)]
    rows += [(5, rows[5][1], "s2"), (90, rows[7][1] + " x", "s1"), (None, rows[8][1], "s0"), (None, text(25), "s0"), (91, None, "s0"), (92, "", None), (93, text(10_000), "s1")]
    rows += [(94, text(20) + " token = \"" + "ab12" * 10 + '"', "s1"), (95, text(20) + " Zx9Kq2Lm8Wp4Rt6Yv1Bn3Cd5", "s1"), (96, text(20) + " Zx9Kq2Lm8Wp4Rt6Yv1Bn3Cd6", "s1"), (97, text(21) + " Zx9Kq2Lm8Wp4Rt6Yv1Bn3Cd6", "s2"), (3, text(22), "s0")]
    given = [] if empty else rows
    names = "doc_id long, text string, lang string, source string, n_chars long, tag string, __key long, __s string, row string"
    spark.createDataFrame([(r[0], r[1], "en", r[2], len(r[1] or ""), "t", 1, "s", "q") for r in given], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(0, 30, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = check(spark, str(tmp_path), given, set(range(0, 30, 2)))
    assert empty or any("<secret>" in r.text for r in got)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.withColumns({c: F.lit(1) for c in ("tag", "__s", "__k", "__key", "__ratio", "number", "base", "all", "tokens", "block", "epoch")})
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    for out in (quality_rules.keep_good(clash, trusted), minhash.one_of_each(clash), secret_scan.redact(clash), mixing.mix_rows(clash).select("row.*")):
        assert out.columns == clash.columns and out.where("tag = 1 and __s = 1 and __key = 1 and base = 1 and epoch = 1").count() == out.count() > 0

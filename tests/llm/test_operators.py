"""Brute-force and behaviour checks of the other operators on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import html_extract, knn_quality, lattice, lm_score, mixing, packing, secret_scan, toxicity


def test_packing_places_every_token_once(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice((0, 1, 7, 100, 511, 512, 513, 3000, 9000))) for k in range(400)] + [(None, 5), (7, 7)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    assert sum(r.n_tokens for r in got) == sum(n for _, n in rows)
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at == rs[0].bin_tokens and rs[0].capacity == min(s for s in packing.SIZES if s >= at)
    assert sum(r.bin_id is None for r in got) == sum(n == 0 for _, n in rows)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def base_spans(text):
    out = []
    for k, (kind, pattern, least) in enumerate((("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24))):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[1]) >= least]
    return [s for _, _, s in sorted(out)]


def test_secrets_against_regex(spark):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    rows = [(1, f"é token = \"{'ab12' * 10}\" and {key}", "s1"), (2, None, None), (3, "", "s1"), (4, "password=token: abcdefgh secret='ok' api_key:zzzzzz", "s2"), (5, f"{key}{key} " + "0" * 30, "s2"), (5, "Zx9Kq2Lm8Wp4Rt6Yv1Bn3Cd5", "s3"), (None, "token=" + "q" * 9, "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secret_scan.scan_secrets(docs).collect()
    want = sorted(hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest() for _, t, _ in rows)
    assert sorted(r.base_sha256 for r in got) == want
    assert any("mixed:" in r.spans for r in got if r.doc_id == 5)
    clean = {r.text for r in secret_scan.redact(docs).collect()}
    assert "<secret>" in clean and None in clean and not any(key in (t or "") for t in clean)
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def test_mixing_uses_every_row_and_holds_the_limit(spark):
    rows = [(k, "w " * (1 + k % 5), "big") for k in range(200)] + [(1000 + k, "w w", "small") for k in range(10)] + [(2000, None, None), (None, "w", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, max_repeats=3.0).collect()
    count = {}
    for r in got:
        count[(r.source, r.doc_id)] = count.get((r.source, r.doc_id), 0) + 1
    assert set(count) == {(s, k) for k, _, s in rows}
    assert max(count.values()) <= 3 and {v for (s, _), v in count.items() if s == "big"} == {1}
    drawn = sum(r.n_tokens for r in got if r.source == "small")
    assert abs(drawn - 3 * 21) <= 2
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_html_made_up_pages_are_read_back():
    rng = random.Random(123)
    pages = [html_extract.made_up_page(rng) for _ in range(150)]
    got = html_extract.extract([p for p, _ in pages], html_extract.trained())
    assert sum(g == "\n\n".join(b) for g, (_, b) in zip(got, pages, strict=True)) >= 140
    assert html_extract.extract([None, "", "<p", "<nav><a href=x>menu</a></nav>"], html_extract.trained())[:3] == ["", "", ""]


def test_html_verdicts_never_clash():
    page = html_extract.Page("<body><article><p>a b<div>c</div></article><footer>d</footer>")
    logp = np.log(np.random.default_rng(0).dirichlet((1, 1, 1), len(page.tag)))
    v = html_extract.decode(page, logp)
    for i in range(1, len(v)):
        if v[page.parent[i]] != html_extract.MIXED:
            assert v[i] == v[page.parent[i]]


def labelled(n=400):
    rng = random.Random(3)
    bad = ["vile", "grubby", "horrid"]
    texts, y = [], []
    for k in range(n):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + rng.choice((".", "", "")) for _ in range(30)]
        if k % 3 == 0:
            words[rng.randrange(30)] = rng.choice(bad)
        texts.append(" ".join(words))
        y.append(int(k % 3 == 0))
    return texts, np.array(y)


def test_toxicity_learns_and_locates():
    texts, y = labelled()
    model = toxicity.train(texts[:300], y[:300])
    score, spans = toxicity.score_texts(pa.array([*texts[300:], None, ""], pa.string()), model)
    assert (((score[:100] >= 0.5) == y[300:]).mean()) >= 0.97
    hit = next(i for i in range(100) if y[300 + i])
    assert any(w in texts[300 + hit][a:b] for a, b in spans[hit] for w in ("vile", "grubby", "horrid"))
    assert score[100] == score[101]


def test_knn_quality_separates_shapes(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(40)]
        rows.append((k, " ".join(w + "%%%" for w in words) if k % 4 == 0 else " ".join(words), "x"))
    docs = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(300)], "doc_id long, quality int")
    got = knn_quality.knn_quality(docs, labels, F.col("doc_id") % 5 == 0).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 301 and len(held) == 60 and all(r.predicted == int(r.doc_id % 4 != 0) for r in held)


def test_lm_score_prefers_the_target(spark):
    rows = [(k, "the cat sat on the mat " * 4 if k % 2 else f"zq{k % 10} xw{k % 10} " * 12) for k in range(60)] + [(None, None), (99, ""), (98, "seen nowhere else at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(k,) for k in range(1, 60, 4)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.lm_score(docs, ids).collect()}
    assert got[3].score > 0 > got[2].score and got[99].score == 0 and got[99].n_tokens == 0
    # a document of the target is not known to the target model because it was counted itself
    assert abs(got[1].score - got[3].score) < 0.1 and got[98].score == 0


def test_lm_model_is_a_distribution():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(40)] + [" ".join(words)]
    # after each word: all words in turn
    asked = [f"{h} {w}" for h in words[:5] for w in words]
    grams = lm_score.Grams(pa.chunked_array([pa.array([*texts, *asked])]))
    counted = grams.doc < len(texts)
    p = np.exp(grams.log_probability(grams.counts(counted), int(counted.sum()), 30, grams.own(), np.zeros(len(texts) + len(asked), bool)))
    ends = Counter(t.split()[-1] for t in texts)
    count = Counter(w for t in texts for w in t.split())
    for k, h in enumerate(words[:5]):
        at = [i for i in np.flatnonzero(grams.follows & ~counted) if grams.doc[i] - len(texts) in range(30 * k, 30 * k + 30)]
        assert abs(p[at].sum() + lm_score.BIGRAM * ends[h] / count[h] - 1) < 1e-12


def test_lm_score_counts_each_ngram_by_itself(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{int(30_000 * rng.random() ** 2)}" for _ in range(rng.choice((1, 50, 150))))) for k in range(600)]
    rows += [(None, "W1 w2 w3"), (700, None), (701, " "), (5, rows[5][1]), *[(800 + k, "same words in each") for k in range(30)]]
    aim = {k for k in range(600) if k % 3 == 0}
    split = [(k, (t or "").lower().split()) for k, t in rows]
    model = {}
    for name, own in (("target", [w for k, w in split if k in aim]), ("background", [w for _, w in split])):
        model[name] = Counter(x for w in own for x in w), Counter(x for w in own for x in zip(w, w[1:], strict=False))
    size = len(model["background"][0])

    def loss(name, w, held):
        words, pairs = model[name]
        if held:  # the document that is scored is left out
            words, pairs = words.copy(), pairs.copy()
            words.subtract(w)
            pairs.subtract(zip(w, w[1:], strict=False))
        total, out = words.total(), 0.0
        for i, x in enumerate(w):
            share = words[x] / total if total else 1 / size
            pair = pairs[w[i - 1], x] / words[w[i - 1]] if i and words[w[i - 1]] else share
            out -= math.log(lm_score.BIGRAM * pair + lm_score.UNIGRAM * share + lm_score.FLOOR / size)
        return out

    want = [(k, len(w), (loss("background", w, True) - loss("target", w, k in aim)) / max(1, len(w))) for k, w in split]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.lm_score(docs, spark.createDataFrame([(k,) for k in aim], "doc_id long")).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    assert [tuple(r)[:2] for r in sorted(got, key=key)] == [w[:2] for w in sorted(want, key=key)]
    assert max(abs(r[2] - w[2]) for r, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True)) < 1e-9
    none = lm_score.lm_score(docs, spark.createDataFrame([], "doc_id long")).collect()
    assert len(none) == len(rows) and not any(r.score for r in none)
    assert lm_score.lm_score(docs.limit(0), docs.select("doc_id")).count() == 0
    long = spark.createDataFrame([(1, "a b c " * 200_000), (1, "a b c " * 200_000), (2, "a b")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in lm_score.lm_score(long, spark.createDataFrame([(2,)], "doc_id long")).collect()) == [2, 600_000, 600_000]


def test_lattice_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 64))
    x = np.concatenate([base, base[:30] + 0.2 * rng.standard_normal((30, 64)), base[:10], 3 * base[:5]]).astype(np.float32)
    label = np.arange(len(x)) % 60 % 3
    label[60:90], label[90:100], label[100:] = label[:30], label[:10], label[:5]
    rows = [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(len(x))] + [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("nan")] * 64, 1), (503, [float(v) for v in x[0]], None)]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    want = link.sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    assert got[90].component_id == 0 and got[0].kept and not got[90].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (500, 501, 502, 503))


def text_of(page):
    return " ".join(t for t in html_extract.Page(page).text if t)


def test_broken_markup_loses_no_text():
    assert text_of("<p title=it's>first</p><p>don't</p><p>third</p>") == "first don't third"
    assert text_of('<p title="a>b" class=\'c>d\'>x</p>') == "x"
    assert text_of('<a href="x>link</a> said "word" here <b class="y">z</b>') == 'link said "word" here z'
    assert text_of("<p>one</p><video src=a.mp4><p>two</p><audio><p>three</p>") == "one two three"
    assert text_of("<video>a</video><p>b<video src=q><p>c<video>d</video>e") == "b c e"
    assert text_of("<svg><svg>a</svg>b</svg>c<object><p>d</p></object>e<iframe>f</iframe>g") == "c e g"
    assert text_of("<script>if (a < b) x = '</p>';</script>a<style>b<p>c") == "a"
    assert text_of("<head><title>t</title><body>b") == "b" and text_of("<headline>h</headline>x") == "h x"
    assert text_of("</div></p>a</x>b<div>c</b></div>") == "a b c" or text_of("</div></p>a</x>b<div>c</b></div>") == "ab c"


def test_unmatched_end_tags_cost_no_square():
    import time

    def cost(n):
        start = time.process_time()
        html_extract.Page("<div>" * n + "</p>" * n + "<svg>" * n + "<video>" * n + "a" * 10)
        return time.process_time() - start

    cost(1000)
    assert cost(16_000) < 12 * max(cost(4000), 0.02)


def test_pages_through_spark(spark):
    page = "<html><body><nav><a href=x>menu</a><a href=y>more</a></nav><article><h1>Title here</h1><p>A first paragraph, with words &amp; marks.</p><p>Second  one\nis here too.</p></article><footer>Copyright</footer></body></html>"
    rows = [(1, "u1", page, 7), (2, None, None, 7), (3, "u3", "", 7), (None, "u4", page, 7), (1, "u1", page, 7), (5, "u5", page.replace("Second", "Second " * 50_000), 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(html_extract.extract_pages(df).collect(), key=str)
    want = "Title here\n\nA first paragraph, with words & marks.\n\nSecond one is here too."
    assert [(r.page_id, r.text) for r in got if r.url in ("u1", "u4")] == [(1, want), (1, want), (None, want)]
    assert all(r.n_chars == len(r.text) for r in got) and {r.page_id for r in got if not r.text} == {2, 3}
    assert [r.n_chars for r in got if r.page_id == 5] == [len(want) + 49_999 * 7]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def naive_packing(lengths, sizes, overhead):
    """Items one by one: (capacity, tokens) of every bin. Bins of equal room are used in the order in which they got it."""
    rest, rooms, out = sum(lengths), {}, []
    for length in sorted(set(lengths), reverse=True):
        left = lengths.count(length)
        rest -= left * length
        while left:
            room = min((r for r in rooms if r >= length and rooms[r]), default=None)
            if room is None:

                def cost(s, left=left, rest=rest, length=length):
                    own = min(left, s // length) * length
                    fill = own + min(s - own, rest)
                    return (min(x for x in sizes if x >= fill) + overhead) / fill

                size = min((s for s in sizes if s >= length), key=cost)
                # so many bins are opened alike as can be filled with this length
                take = min(size // length, left)
                for _ in range(max(1, left // (size // length))):
                    rooms.setdefault(size - take * length, []).append(size)
                    left -= take
                continue
            size = rooms[room].pop(0)
            rooms.setdefault(room - length, []).append(size)
            left -= 1
    for room, opened in rooms.items():
        out += [(min(s for s in sizes if s >= size - room), size - room) for size in opened]
    return sorted(out)


def test_bins_against_items_one_by_one():
    rng = random.Random(9)
    for _ in range(300):
        sizes = sorted(rng.sample(range(8, 80), rng.randint(1, 4)))
        lengths = [rng.randint(1, sizes[-1]) for _ in range(rng.randint(0, 120))]
        ranges, bins = packing.plan_bins(Counter(lengths), sizes, 3)
        got = sorted((int(c), int(t)) for _, n, c, t in bins for _ in range(n))
        assert got == naive_packing(lengths, sizes, 3)
        used = Counter()
        for length, _, n, first, at in ranges.tolist():
            for k in range(n):
                used[first + k] += length
        assert sorted(used.values()) == [t for _, t in sorted(got, key=lambda x: x[1])]
        assert all(t <= c for c, t in got)


def test_packing_with_texts_copies_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 3)
    rows = [(1, "a b c", 1)] * 8 + [(1, "d e", 1), (None, "f", 1), (None, "g", 1), (2, None, 1), (3, " ".join(f"w{i}" for i in range(25)), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = packing.pack_documents(docs, with_text=True, sizes=(8, 10)).collect()
    assert sorted(r["copy"] for r in got if r.text == "a b c") == list(range(8))
    assert sorted(r.text for r in got if r.doc_id is None) == ["f", "g"]
    assert [r.text for r in sorted((r for r in got if r.doc_id == 3), key=lambda r: r.piece)] == [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 10), (10, 20), (20, 25))]
    places = [(r.bin_id, r.bin_offset + k) for r in got if r.bin_id is not None for k in range(r.n_tokens)]
    assert len(places) == len(set(places)) == 8 * 3 + 2 + 2 + 25
    assert packing.pack_documents(docs.limit(0), with_text=True).count() == 0


def test_sample_passes_over_texts_that_do_not_fit(spark):
    from faultline.llm.training import fitting, labelled_sample

    assert fitting([100, 3, 3, 3, 9], [0, 0, 1, 1, 0], 20) == [False, True, True, True, True]
    assert fitting([9, 9, 2], [0, 0, 0], 20) == [True, True, True]
    rows = [(k, "x" * (500 if k == 7 else 10)) for k in range(50)] + [(3, "y"), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(None, 1)], "doc_id long, label int")
    got = labelled_sample(docs, labels, 100, 491)
    assert len(got) == 49 and 7 not in set(got["doc_id"])
    assert labelled_sample(docs.limit(0), labels, 10).empty and labelled_sample(docs, labels.limit(0), 10).empty


def test_toxicity_through_spark(spark):
    texts, y = labelled(300)
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[0], 1), (0, texts[0], 1), (900, None, 1), (901, "", 1), (902, "alpha. " * 100_000 + "vile", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, toxic int")
    held = F.col("doc_id") % 3 == 1
    got = toxicity.toxicity(docs, labels, held).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert sum((by[k].score >= 0.5) == bool(y[k]) for k in range(1, 300, 3)) >= 97
    assert by[None].score == by[0].score and not by[None].held_out and by[900].score == by[901].score
    assert [by[902].offending[-1]] == [[700_000, 700_004]] and all(r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.toxicity(docs.limit(0), labels, held).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 1"), held).collect()} == {0.5}


def test_knn_votes_against_plain_python(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(("ab", "cd", "ef", "gh", "IJ", "12")) for _ in range(12)), 0) for k in range(120)]
    rows += [(500, rows[3][1], 0), (501, None, 0), (502, "", 0), (None, rows[3][1], 0), (503, "ab cd " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r for r in knn_quality.knn_quality(docs, labels, F.col("doc_id") % 5 == 0).collect()}
    known = [k for k in range(120) if k % 5]
    df = np.zeros(knn_quality.DIMS)
    for _, t, _ in rows:
        df += np.bincount(knn_quality.term_counts(pa.array([t], pa.string()))[1], minlength=knn_quality.DIMS)
    space = knn_quality.Space([rows[k][1] for k in known], np.array([k % 2 for k in known], float), (48, 48), df.astype(np.int64), len(rows))
    unit = lambda t: space.embed(pa.array([t]))[0].astype(float)
    vectors = [unit(rows[k][1]) for k in known]
    for k in (5, 10, 500, 503):
        t = next(t for i, t, _ in rows if i == k)
        cosine = sorted(((float(unit(t) @ v), space.votes[i], known[i] % 2) for i, v in enumerate(vectors)), key=lambda x: -x[0])
        if abs(cosine[knn_quality.K - 1][0] - cosine[knn_quality.K][0]) > 1e-5:
            near = [(max(c, 0) ** 4 * v, y) for c, v, y in cosine[: knn_quality.K]]
            assert abs(got[k].score - sum(w * y for w, y in near) / sum(w for w, _ in near)) < 1e-3
    assert got[500].score == got[3].score == got[None].score and got[501].score == got[502].score == 0.5
    assert knn_quality.knn_quality(docs.limit(0), labels, F.col("doc_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("hot", [2, 100_000])
def test_owners_tell_examples_from_live_values(spark, monkeypatch, hot):
    monkeypatch.setattr(secret_scan, "HOT_ROWS", hot)
    one, two, three = (f"Zx9Kq2Lm8Wp4Rt6Yv1Bn3Cd{k}" for k in "abc")
    rows = [(k, f"key {one} in it", f"owner{k}/repo") for k in range(5)] + [(10 + k, f"key {two} in it", f"acme/repo{k}") for k in range(5)]
    rows += [(20, f"{'w ' * 200_000}{three} {one}", "solo/r"), (21, f"{two} and {two}", None), (22, "nothing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assert all(got[k].spans == "" and (got[k].n_live, got[k].n_example) == (0, 1) for k in range(5))
    # one owner, however many repositories; but a null owner is another one
    assert all((got[10 + k].n_live, got[10 + k].n_example) == (0, 1) for k in range(5)) and got[21].n_example == 1
    assert got[20].spans == "mixed:400000:400024" and (got[20].n_live, got[20].n_example) == (1, 1) and got[22].spans == ""
    own = {r.doc_id: r for r in secret_scan.scan_secrets(docs.where("doc_id between 10 and 20"), repo=F.col("source")).collect()}
    assert all(own[10 + k].spans == "mixed:4:28" and own[10 + k].n_live == 1 for k in range(5))
    found = secret_scan._found(docs.selectExpr("doc_id AS row", "text", "coalesce(source, '') AS repo", "substring_index(coalesce(source, ''), '/', 1) AS owner"), keep_text=False)
    assert sorted((r.n_repos, r.n_owners) for r in secret_scan.verdicts(found).collect()) == [(1, 1), (6, 2), (6, 6)]


def test_mixing_reads_long_texts_and_tells_null_ids_apart(spark):
    rows = [(None, f"text number {k}", "a") for k in range(50)] + [(1, "w " * 300_000, "b"), (2, "w", None), (2, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, max_repeats=2.0).collect()
    assert len({r.block_key for r in got if r.source == "a" and r.epoch == 0}) > 40
    assert sum(r.n_tokens for r in got if r.source == "b") == 300_000
    assert sum(r.source is None and r.epoch == 0 for r in got) == 2
    few = mixing.mix_sources(docs, max_repeats=1.0, budget_tokens=150_000).collect()
    assert all(r.epoch == 0 for r in few)


@pytest.mark.parametrize("block", [4, 1000])
def test_dense_groups_in_blocks_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(block)
    base = rng.standard_normal((3, 32))
    x = np.concatenate([base[k] + 0.05 * rng.standard_normal((n, 32)) for k, n in enumerate((40, 15, 3))] + [rng.standard_normal((20, 32))])
    x = np.concatenate([x, x[:6], x[3:5]])
    ids = rng.permutation(len(x))
    label = np.r_[np.zeros(40), np.ones(15), np.zeros(3), np.arange(20) % 2, np.zeros(6), np.zeros(2)].astype(int)
    rows = [(int(i), [float(v) for v in vec], int(y), 1) for i, vec, y in zip(ids, x, label, strict=True)] + [(None, [float(v) for v in x[0]], 0, 1), (901, None, 0, 1), (902, [1.0] * 8, 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int")
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    y = np.concatenate([x, x[:1]])
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    lab = np.r_[label, 0]
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    assert [got[int(i)].n_links for i in ids] == [int(n) - 1 for n in link.sum(1)[:-1]] and got[None].n_links == link[-1].sum() - 1
    low = {}
    for k, i in enumerate(ids):
        reach = {k}
        while True:
            more = set(np.flatnonzero(link[list(reach)].any(0)).tolist())
            if more <= reach:
                break
            reach |= more
        low[int(i)] = min(int(ids[m]) for m in reach if m < len(ids))
    assert {k: r.component_id for k, r in got.items() if k is not None and k < 900} == low
    assert got[901].n_links == got[902].n_links == 0 and got[901].component_id == 901
    assert lattice.near_duplicates(df.limit(0)).count() == 0

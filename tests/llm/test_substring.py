"""Removal of repeated passages against brute force, and the index behind it."""

import random

import numpy as np
import pytest

from faultline.llm import substring, tokens
from faultline.llm.fm_index import FMIndex, WaveletTree, suffix_order


def naive(rows, window):
    """(doc_id, n_words, kept) of each row."""
    seen = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            seen[key] = min(seen.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if seen[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def test_suffixes_counts_and_matches():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (70, 3), (300, 2), (1000, 40)):
        s = rng.integers(0, kinds, n)
        assert suffix_order(s).tolist() == sorted(range(n), key=lambda i: tuple(s[i:]))
        tree = WaveletTree(s, kinds)
        places = rng.integers(0, n + 1, 50)
        symbols = rng.integers(0, kinds, 50)
        assert tree.counts(symbols, places).tolist() == [int((s[:p] == c).sum()) for c, p in zip(symbols, places, strict=True)]
    for seed in range(20):
        rng = np.random.default_rng(seed)
        texts = [rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64) for _ in range(12)]
        owners = rng.integers(0, 6, 12)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        a, b, e = FMIndex(np.concatenate(texts), at, owners).passages(np.concatenate(texts), at, owners, 5)
        covered = {(int(t), int(k)) for t, x, y in zip(a, b, e, strict=True) for k in range(x, y)}
        want = set()
        for i, t in enumerate(texts):
            for k in range(len(t) - 4):
                if any(owners[j] < owners[i] and any((u[m : m + 5] == t[k : k + 5]).all() for m in range(len(u) - 4)) for j, u in enumerate(texts)):
                    want |= {(i, m) for m in range(k, k + 5)}
        assert covered == want


def test_equal_windows_name_equal_grams(monkeypatch):
    rng = np.random.default_rng(1)
    words = tokens.mix(rng.integers(0, 50, 3000).astype(np.uint64))
    words[2000:2300] = words[100:400]
    for size in (substring.SLICE, 128):
        monkeypatch.setattr(substring, "SLICE", size)
        of = {}
        for _, begin, end, gram, _ in substring.segments(words, np.array([0, 1000, 3000]), 30, 5):
            for a, b, g in zip(begin, end, gram, strict=True):
                for k in range(a, b - 29):
                    of.setdefault(k, set()).add(int(g))
        assert all(of[1000 + k] & of[100 + k] for k in range(270))


@pytest.mark.parametrize("hot", [substring.HOT, 2])
def test_passages_against_brute_force(spark, monkeypatch, hot):
    """Passages in the midst of other words, near copies, repeats in a document, a passage in a third of all documents, in ids of any order."""
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 700)
    rng = random.Random(hot)
    word = lambda: f"w{rng.randrange(400)}é"
    passages = [[word() for _ in range(n)] for n in (11, 12, 13, 30, 90)]
    rows = []
    for k in range(150):
        w = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        if k % 3 == 0:
            w += passages[2]
        rows.append((rng.randrange(100), rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(200, None), (201, ""), (202, " \n "), (None, " ".join(passages[4])), (None, None), (203, " ".join(passages[3] * 8)), (1, "x y   z"), rows[0], rows[5]]
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, source string, h int, gram int")
    got = substring.remove_repeats(docs, window=12, gram=4).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=str) == naive(rows, 12)
    assert all(a.end < b.begin for r in got for a, b in zip(r.removed, r.removed[1:], strict=False))
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_long_text_and_bad_sizes(spark):
    text = " ".join(str(k % 977) for k in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "lead " + text + " tail"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert got[1].removed == [] and got[2].kept == "lead tail" and [tuple(s) for s in got[2].removed] == [(1, 100_001)] and got[3].kept == "short"
    with pytest.raises(ValueError):
        substring.remove_repeats(docs, window=5, gram=6)

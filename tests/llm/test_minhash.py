import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import minhash

SF = "/root/testdata/sf0.01"


def brute(rows, words=3, percent=85):
    """component ids by comparing all pairs of exact string sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in holders[x]:
                common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if j > i and 100 * c >= percent * (len(s) + len(sets[j]) - c):
                root[find(j)] = find(i)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        low[r] = min(low.get(r, k), k)
    return {k: (len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows)}


def test_all_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[: 60 - k % 7] + [f"x{k}"])) for k in range(40)] + [(100 + k, f"other text number {k} here") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == brute(rows)


def test_unusual_input(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n ", 1), (4, "one two", 1), (5, "ONE two", 1), (5, "ONE two", 1), (None, "one TWO", 1), (None, None, 1), (6, "long " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=3, percent=85).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (-1, 1, 4, False), (-1, 0, None, True), (6, 1, 6, True)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 30, 3000])
def test_sketch_fills_and_estimates(n):
    rng = np.random.default_rng(n)
    x = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
    a, b = x[: int(len(x) * 0.9)], x[int(len(x) * 0.1) :]
    s, t = minhash.sketch(a, 512), minhash.sketch(b, 512)
    assert (s != 0).all() and (minhash.sketch(a, 512) == s).all()
    true = len(np.intersect1d(a, b)) / len(x)
    assert abs((s == t).mean() - true) < 0.12


def test_sets_equal_strings():
    texts = ["A b c d", "a B C", "x", None, "a b c d a b c"]
    assert [len(s) for s in minhash.shingle_sets(pa.array(texts), 3)] == [2, 1, 1, 0, 4]


def joined(sets, links):
    root = list(range(len(sets)))
    for i, j in links:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    return {frozenset(k for k, r in enumerate(root) if r == x) for x in root}


def near(sets, side, percent):
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if side[i] != side[j] or side[0] == side[-1]]
    return [(i, j) for i, j in pairs if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - c)]


def test_members_put_off_under_two_components_still_meet():
    core, a, b, c, d = np.split(np.arange(1150, dtype=np.uint64), [800, 900, 1000, 1070])
    i, j, y = np.r_[core, a], core, np.r_[core, c]
    sets, side = [i, np.r_[i, b], j, y, np.r_[y, d]], np.zeros(5, int)
    assert joined(sets, minhash.spanning_links(sets, side, 85)) == joined(sets, near(sets, side, 85)) == {frozenset(range(5))}


def test_chains_against_all_pairs():
    rng = np.random.default_rng(7)
    for turn in range(60):
        sets = [np.arange(200, dtype=np.uint64)]
        for k in range(40):  # each drops and adds a few elements of an earlier one
            x = sets[rng.integers(len(sets))]
            new = np.arange(rng.integers(0, 30), dtype=np.uint64) + np.uint64(1000 * (k + 1))
            sets.append(np.sort(np.r_[x[rng.random(len(x)) > rng.choice((0, 0.1))], new]))
        side = np.sort(rng.integers(0, 2, len(sets))) if turn % 2 else np.zeros(len(sets), int)
        assert joined(sets, minhash.spanning_links(sets, side, 85)) == joined(sets, near(sets, side, 85))


def drifting(rng, words=60):
    """A chain of texts, each some words away from an earlier one."""
    out = [[f"c{rng.integers(1 << 30)}_{i}" for i in range(words)]]
    for k in range(int(rng.integers(4, 24))):
        w = list(out[rng.integers(len(out))])
        for _ in range(int(rng.integers(0, 4))):
            w[rng.integers(len(w))] = f"n{rng.integers(1 << 30)}"
        if rng.random() < 0.3:
            w += [f"e{rng.integers(1 << 30)}_{k}_{i}" for i in range(int(rng.integers(1, 12)))]
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("block", [150, 1_000_000])
def test_drifting_texts_in_mixed_id_orders(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(block)
    texts = [t for _ in range(60) for t in drifting(rng)]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == brute(rows)


def test_thousands_of_drifting_chains_lose_no_component():
    rng = np.random.default_rng(3)
    for turn in range(3000):
        sets = [np.arange(100, dtype=np.uint64)]
        for k in range(int(rng.integers(5, 24))):
            x = sets[rng.integers(len(sets))]
            new = np.arange(int(rng.integers(0, 12)), dtype=np.uint64) + np.uint64(1000 * (k + 1))
            sets.append(np.sort(np.r_[x[rng.random(len(x)) > rng.choice((0, 0.03, 0.08))], new]))
        sets = [sets[i] for i in rng.permutation(len(sets))]
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        member = np.zeros((len(sets), len(values)), np.int32)
        member[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), at] = 1
        common, n = member @ member.T, member.sum(1)
        hit = 100 * common >= 85 * (n[:, None] + n[None, :] - common)
        assert joined(sets, minhash.spanning_links(sets, np.zeros(len(sets), int), 85)) == joined(sets, list(zip(*np.nonzero(hit), strict=True))), turn


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(3, a, "r1"), (5, a + " more", "r2"), (5, b, "r3"), (9, b + " more", "r4"), (9, b + " more", "r4"), (None, a, "r5"), (11, "", "r6"), (12, None, "r7"), (12, None, "r7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=3, percent=85).collect()), key=str)
    assert got == sorted([(3, 58, 3, True), (5, 59, 3, False), (5, 58, 5, True), (9, 59, 5, False), (9, 59, 5, False), (0, 58, 3, False), (11, 0, 11, True), (12, 0, 12, True), (12, 0, 12, True)], key=str)
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.h for r in left.collect()) == ["r1", "r3", "r6", "r7"]
    assert minhash.one_of_each(docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "h AS __row", "1 AS node", "2 AS component", "3 AS __at")
    assert sorted(r[2] for r in minhash.one_of_each(clash).collect()) == ["r1", "r3", "r6", "r7"]

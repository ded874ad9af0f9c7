"""Hard negatives against all pairs, and the bounds behind them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import hard_negatives as hn


def naive(rows, every, positives, negatives):
    good = [(i, lab, np.floor(256 * np.array(v, float)).astype(int).tolist()) for i, v, lab in rows if lab is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    late = lambda i: 1 << 63 if i is None else i
    out = []
    for a, (i, lab, x) in enumerate(good):
        if i is None or i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), late(j), b, j, other) for b, (j, other, y) in enumerate(good) if b != a and len(y) == len(x))
        for ps, _, _, p, _ in [s for s in scored if s[4] == lab][:positives]:
            fits = [s for s in scored if s[4] != lab and -30 * ps <= -100 * s[0] <= -90 * ps][:negatives]
            out += [(i, p, k + 1, s[3], -ps, -s[0]) for k, s in enumerate(fits)]
    return sorted(out, key=str)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (300, 6)) * rng.integers(0, 2, 6)
    marks = hn.fit_marks(x[:40]).astype(np.int64)
    low, high = hn.tables(x[0], marks, x.min(0), x.max(0))
    part = hn._File(np.arange(300), np.arange(300), np.zeros(300), hn.cells_of(x, marks), x)
    lo, hi = part.bounds(low, high)
    s = x @ x[0]
    assert (lo <= s).all() and (s <= hi).all() and (hi - lo).mean() < 0.2 * np.ptp(s)


@pytest.mark.parametrize("wave", [hn.WAVE, 7])
def test_against_all_pairs(spark, monkeypatch, wave):
    """Ties, repeated rows and ids, nulls, other lengths, one label with half of all rows, several waves of anchors and parts."""
    monkeypatch.setattr(hn, "WAVE", wave)
    monkeypatch.setattr(hn, "ROWS", 50)
    monkeypatch.setattr(hn, "SAMPLE", 60)
    rng = np.random.default_rng(wave)
    rows = []
    for k in range(400):
        v = np.round(rng.standard_normal(8) + (2 if k % 3 else 0.5), 1).tolist()
        rows.append((k, v, int(rng.integers(0, 4)) if k % 2 else 0))
    rows += [rows[10], rows[11], (10, rows[12][1], 0), (None, rows[13][1], 1), (None, rows[13][1], 1), (1000, rows[14][1], None), (1001, None, 1), (1002, [], 1), (1003, [None] * 8, 1), (1004, [float("nan")] * 8, 1), (1010, rows[15][1][:3], 1), (1011, rows[15][1][:3], 1), (1012, rows[15][1][:3], 2), (1020, [0.0] * 8, 2), (-20, rows[16][1], 3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rank int, anchor string").repartition(5)
    got = hn.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), positives=3, negatives=4).collect()
    want = naive(rows, 10, 3, 4)
    assert sorted((tuple(r) for r in got), key=str) == want and len(want) > 300


def test_empty_and_overflow(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    big = spark.createDataFrame([(k, [1e9, 1e9], k % 2) for k in range(4)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(OverflowError):
        hn.hard_negatives(big, F.col("vec_id") % 2 == 0, F.col("label"))

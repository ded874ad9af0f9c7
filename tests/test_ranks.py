"""Ranks and medians against pandas: a hot group, a hot value, null keys and values, several ranges, empty tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 6000
    g = np.where(rng.random(n) < 0.7, "hot", np.array(["a", "b", "c"])[rng.integers(0, 3, n)])
    v = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.normal(0, 50, n), 1))
    frame = pd.DataFrame({"id": range(n), "g": g, "v": v, "w": rng.integers(0, 9, n).astype(float)})
    frame.loc[frame.id % 97 == 0, "g"] = None
    frame.loc[frame.id % 89 == 0, "v"] = np.nan
    clean = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(clean, "id long, g string, v double, w double").repartition(7), frame


def test_one_group_lies_in_many_ranges(spark, rows):
    df, _ = rows
    cut = ranks.ranged(df.where("g = 'hot'"), ["g"], "v", parts=8)
    spread = cut.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("__range").collect()
    assert len(spread) >= 6 and max(r.n for r in spread) < 2 * sum(r.n for r in spread) / len(spread)
    assert all(a.hi < b.lo for a, b in zip(spread, spread[1:], strict=False))


@pytest.mark.parametrize("parts", [1, 9])
def test_ranks_and_medians(rows, parts):
    df, frame = rows
    want = frame.assign(k=frame.g.fillna("?"))
    want["r"] = want.groupby("k").v.rank(method="average")
    got = {r.id: r.rank for r in ranks.average_rank(df, "v", "rank", ["g"], parts).collect()}
    assert len(got) == len(frame)
    assert all((got[i] is None and np.isnan(r)) or got[i] == r for i, r in zip(want.id, want.r, strict=True))
    for r in ranks.medians(df, ["g"], "v", parts).collect():
        v = np.sort(want[want.k == (r.g or "?")].v.dropna())
        assert (r.n, r.median, r.upper_median) == (len(v), np.median(v), v[len(v) // 2])


def test_correlation(rows):
    df, frame = rows
    both = frame.assign(k=frame.g.fillna("?")).dropna(subset=["v"])
    found = ranks.spearman(df, "v", "w", ["g"], 5).collect()
    assert len(found) == both.k.nunique()
    for r in found:
        part = both[both.k == (r.g or "?")]
        gap, n = part.v.rank() - part.w.rank(), len(part)
        assert r.n == n and abs(r.rho - (1 - 6 * float((gap**2).sum()) / (n * (n * n - 1)))) < 1e-12


def test_all_rows_in_one_and_empty(spark, rows):
    df, frame = rows
    one = ranks.described(df, [], "v").collect()
    v = frame.v.dropna()
    assert len(one) == 1 and one[0].n == len(v) and one[0].median == v.median() and abs(one[0].std - v.std()) < 1e-9
    none = df.where("id < 0")
    assert ranks.medians(none, ["g"], "v").collect() == [] and ranks.spearman(none, "v", "w", ["g"]).collect() == []
    two = spark.createDataFrame([("x", 1.0, 2.0), ("x", 2.0, 1.0)], "g string, v double, w double")
    assert [tuple(r) for r in ranks.spearman(two, "v", "w", ["g"]).collect()] == [("x", 2, 0.0)]

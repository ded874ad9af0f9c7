"""Whitening against exact arithmetic, and the parts behind it."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import eigen, queries, whitening


def test_pairs_lose_nothing():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(500) * 10.0 ** rng.integers(-8, 8, 500), rng.standard_normal(500)
    for f, op in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        high, low = f(a, b)
        assert all(Fraction(h) + Fraction(e) == op(Fraction(x), Fraction(y)) for h, e, x, y in zip(high, low, a, b, strict=True))
    values = np.concatenate([[1e16, 1.0, -1e16], a, -a[::-1]])
    high, low = whitening.total(values, np.zeros_like(values))
    assert high == 1.0 and abs(low) < 1e-14


@pytest.mark.parametrize("case", ["random", "repeated", "ones", "zero", "graded", "clusters", "one"])
def test_eigenvectors(case):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    a = {"random": (x := rng.standard_normal((90, 33))).T @ x, "repeated": np.eye(20), "ones": np.ones((30, 30)), "zero": np.zeros((4, 4)), "graded": np.diag(10.0 ** np.arange(-9, 9)), "clusters": (q * np.repeat([1, 2, 3, 3 + 1e-13], 10)) @ q.T, "one": np.array([[3.0]])}[case]
    values, vectors = eigen.symmetric(a)
    size = max(1.0, np.abs(a).max())
    assert (np.diff(values) <= 0).all()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * size


def exact(vectors, scale, shift):
    x = [[math.floor(scale * c) + shift for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[c - Fraction(s, n) for c, s in zip(r, sums, strict=True)] for r in x]
    cov = [[sum(r[i] * r[j] for r in y) / n for j in range(len(sums))] for i in range(len(sums))]
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x], np.array(y, float), np.array([[float(c) for c in r] for r in cov])


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((80, 9)) * np.arange(1, 10) + 3).astype(np.float32).tolist()
    vectors[7] = vectors[3]
    odd = [None, [None] + [1.0] * 8, [float("nan")] * 9, [float("inf")] + [0.0] * 8, []]
    other = [[float(k), float(k * k % 5)] for k in range(6)]
    rows = [(k, v, 1, "x", 2) for k, v in enumerate(vectors + odd + other)] + [(None, vectors[0], 1, "x", 2), (3, vectors[5], 1, "x", 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, whitened string, part int")
    for part, of in ((9, vectors + [vectors[0], vectors[5]]), (2, other)):
        n, deviation, y, cov = exact(of, 64, 1_000_000)
        got = whitening.whiten(df.repartition(7)).where(F.size("whitened") == part).collect()
        assert len(got) == n and all(r.n == n for r in got)
        assert sorted(int(r.deviation) for r in got) == sorted(deviation)
        values = np.linalg.eigvalsh(cov)[::-1]
        assert np.allclose(got[0].explained, values / values.sum(), rtol=1e-10)
        w = np.array([r.whitened for r in got])
        assert np.abs(np.cov(w.T, bias=True) - np.eye(part)).max() < 1e-9 and got[0].identity_error < 1e-9
        ids = [k if k is not None else -1 for k in (r.vec_id for r in got)]
        assert len(set(ids)) == len(of) - (part == 9)
    m = whitening.fit(df.where("vec_id < 80 and vec_id <> 3").where(F.col("embedding").isNotNull()).select(F.col("embedding").cast("array<double>").alias("v")))[9]
    cov = exact([v for k, v in enumerate(vectors) if k != 3], 64, 1_000_000)[3]
    assert np.abs(m["covariance"] - cov).max() <= 1e-15 * np.abs(cov).max()


def test_no_variance_and_empty(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert all(r.whitened == [] and r.deviation == 0 and r.n == 5 for r in whitening.whiten(df).collect())
    assert whitening.whiten(df.limit(0)).count() == 0


def test_query(spark):
    """Every vector of the table with 32 components of unit variance, whatever the partitions."""
    sf = "/root/testdata/sf0.001"
    rows = queries.op12_embedding_whitening(spark, sf).collect()
    n, deviation, y, cov = exact([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], 64, 1_000_000)
    assert len(rows) == 32 * n
    rows.sort(key=lambda r: (r.vec_id, r.component))
    assert [r.deviation for r in rows[::32]] == deviation
    w = np.array([r.whitened for r in rows]).reshape(n, 32)
    values, frame = np.linalg.eigh(cov)
    want = y @ frame[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    assert np.abs(np.abs((w * want).sum(0) / n) - 1).max() < 1e-9
    assert np.allclose([r.explained for r in rows[:32]], values[::-1][:32] / np.trace(cov), rtol=1e-9)

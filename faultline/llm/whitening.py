"""Whitened embeddings from a covariance in double-double precision.

1. Exact whole-number sums give the mean, kept as a pair of doubles (its value and what rounding left).
2. Rows are centred, and the products of each pair of dimensions are formed and summed without losing
   a rounding error: a product is its rounded value and the error, found by splitting factors in halves; a sum is its rounded value
   and the error. A task returns high and low parts of its sums; they are merged by the same rule, a row of the matrix in a group.
3. The covariance, whose size depends on the dimensions alone, is decomposed on the driver (eigen: reduction to
   tridiagonal form, then divide and conquer).
4. A scan projects each row on the first components, scaled to unit variance. One more scan measures the covariance of
   what comes out, centred by its own mean, against the identity.

Defined results: rows with a null or empty vector or a null or non-finite component are left out. Vectors of different lengths are
whitened apart, each length with its own list. Components without variance (eigenvalue at most length * 2**-52 of the trace) have no
unit form and are left out, so a single row, or equal rows, have none. Null ids and repeated rows are rows
like others; extra columns are ignored; an empty table gives an empty result. Components of 2**52 and more after scaling are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready
from .eigen import symmetric

#: Rows and pairs of dimensions whose products are formed together.
ROWS, PAIRS = 64, 2080


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded product and its error."""

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = 134217729.0 * x
        high = c - (c - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two pairs (high, low)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    high = s + e
    return high, e - (high - s)


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of pairs along the first axis, by halves."""
    while len(high) > 1:
        m = len(high) // 2
        h, lo = add((high[:m], low[:m]), (high[m : 2 * m], low[m : 2 * m]))
        if len(high) % 2:
            h, lo = np.concatenate([h, high[-1:]]), np.concatenate([lo, low[-1:]])
        high, low = h, lo
    return high[0], low[0]


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean as pairs."""
    s, e = two_sum(x.astype(np.float64), -mean[0])
    e = e - mean[1]
    high = s + e
    return high, e - (high - s)


class Products:
    """Sums of the products of all pairs of dimensions, as pairs; the upper triangle, flat."""

    def __init__(self, dim: int):
        self.i, self.j = np.triu_indices(dim)
        self.high, self.low = np.zeros(len(self.i)), np.zeros(len(self.i))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        for r in range(0, len(high), ROWS):
            h, lo = high[r : r + ROWS], low[r : r + ROWS]
            for p in range(0, len(self.i), PAIRS):
                i, j, at = self.i[p : p + PAIRS], self.j[p : p + PAIRS], slice(p, p + PAIRS)
                value, error = two_product(h[:, i], h[:, j])
                error = error + (h[:, i] * lo[:, j] + lo[:, i] * h[:, j])
                self.high[at], self.low[at] = add((self.high[at], self.low[at]), total(value, error))


def _whole(flat: np.ndarray, scale: int, shift: int) -> np.ndarray:
    x = np.floor(flat.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= 1 << 52:
        raise OverflowError("components are too large for exact sums")
    return x.astype(np.int64) + shift


def _by_length(b: pa.RecordBatch, column: int, scale: int, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the vectors of a batch: the length, its rows and their whole numbers."""
    v = b.column(column)
    size = np.diff(np.asarray(v.offsets))
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield int(length), rows, _whole(v.take(pa.array(rows)).flatten().to_numpy(), scale, shift).reshape(-1, length)


def _sums(scale: int, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list] = {}
        for b in batches:
            for length, rows, x in _by_length(b, 0, scale, shift):
                s = out.setdefault(length, [0, np.zeros(length, np.int64), np.zeros(length, np.int64)])
                s[0] += len(rows)
                s[1] += (x >> 32).sum(0)
                s[2] += (x & 0xFFFFFFFF).sum(0)
        for length, (n, high, low) in out.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(length, length)), pa.array(np.arange(length)), pa.array(np.full(length, n)), pa.array(high), pa.array(low)], names=["length", "d", "n", "high", "low"])

    return run


def _parts(length: int, high: list[np.ndarray], low: list[np.ndarray]) -> pa.RecordBatch:
    """A row of partial sums for each row of a matrix."""
    k = len(high)
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([length] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array([part] * k, pa.int64()), pa.array(high, pa.list_(pa.float64())), pa.array(low, pa.list_(pa.float64()))], names=["length", "i", "part", "high", "low"])


_PARTS = "length long, i long, part long, high array<double>, low array<double>"


def _merge(rows: pa.Table) -> pa.Table:
    """The sum of one row of a matrix over all tasks, in their order."""
    rows = rows.sort_by("part").combine_chunks()
    high, low = total(np.array(rows["high"].to_pylist()), np.array(rows["low"].to_pylist()))
    return pa.table({"length": rows["length"][:1], "i": rows["i"][:1], "part": rows["part"][:1], "high": pa.array([high], pa.list_(pa.float64())), "low": pa.array([low], pa.list_(pa.float64()))})


def _matrix(parts: DataFrame) -> dict[int, list]:
    """For each length the merged rows in order: pairs of high and low parts. As large as the matrix."""
    out: dict[int, list] = {}
    for r in sorted(parts.groupBy("length", "i").applyInArrow(_merge, _PARTS).collect(), key=lambda r: (r.length, r.i)):
        out.setdefault(r.length, []).append((np.array(r.high), np.array(r.low)))
    return out


def _covariances(means: dict, scale: int, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Products] = {}
        for b in batches:
            for length, _, x in _by_length(b, 0, scale, shift):
                sums.setdefault(length, Products(length)).add(*centred(x, means[length]))
        for length, s in sums.items():
            cuts = np.cumsum(np.arange(length, 1, -1))
            yield _parts(length, np.split(s.high, cuts), np.split(s.low, cuts))

    return run


def _projected(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray], frame: np.ndarray) -> np.ndarray:
    return centred(x, mean)[0] @ frame


def _identities(models: dict, scale: int, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each component the sums of its products with all components, and its own sum, about a task's own mean (n, sum and the rest merge by addition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for length, _, x in _by_length(b, 0, scale, shift):
                w = _projected(x, models[length]["mean"], models[length]["frame"])
                s = np.concatenate([w.T @ w, w.sum(0)[:, None]], axis=1)
                sums[length] = sums.get(length, 0) + s
        for length, s in sums.items():
            if len(s):
                yield _parts(length, list(s), list(np.zeros_like(s)))

    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over dimensions of (n * x - sum)**2 of each row, exact."""
    top = max((abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums)))) if x.size else 0
    if top * top * max(1, x.shape[1]) < 1 << 63:
        y = x * n - np.array(sums, np.int64)
        return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
    whole = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return pa.array([Decimal(int(v)) for v in whole], pa.decimal128(38, 0))


def _whitened(models: dict, scale: int, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, rows, x in _by_length(b, 1, scale, shift):
                m = models[length]
                w = _projected(x, m["mean"], m["frame"])
                k = w.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel()))
                explained = pa.array([m["explained"]] * len(w), kind)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.full(len(w), m["n"])), _deviations(x, m["n"], m["sums"]), lists, explained, pa.array(np.full(len(w), m["identity_error"]))], names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def fit(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000, top: int = 32) -> dict[int, dict]:
    """For each length of the vectors in the one column: n, sums, mean, covariance, explained, frame (length by components) and identity_error."""
    found = vectors.mapInArrow(_sums(scale, shift), "length long, d long, n long, high long, low long")
    found = found.groupBy("length", "d").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    models: dict[int, dict] = {}
    for r in sorted(found):
        m = models.setdefault(r.length, {"n": r.n, "sums": []})
        m["sums"].append((r.high << 32) + r.low)
    for m in models.values():
        exact = [Fraction(s, m["n"]) for s in m["sums"]]
        high = np.array([float(f) for f in exact])
        m["mean"] = high, np.array([float(f - Fraction(h)) for f, h in zip(exact, high.tolist(), strict=True)])
    if not models:
        return models
    means = {k: m["mean"] for k, m in models.items()}
    for length, rows in _matrix(vectors.mapInArrow(_covariances(means, scale, shift), _PARTS)).items():
        m, v = models[length], np.zeros((length, length))
        for i, (high, low) in enumerate(rows):
            v[i, i:] = v[i:, i] = high / m["n"] + low / m["n"]
        values, frame = symmetric(v)
        trace = float(np.trace(v))
        k = min(top, int((values > length * 2.0**-52 * trace).sum()))
        m |= {"covariance": v, "explained": (values[:k] / trace).tolist(), "frame": frame[:, :k] / np.sqrt(values[:k]), "identity_error": 0.0}
    sent = {k: {"mean": m["mean"], "frame": m["frame"]} for k, m in models.items()}
    for length, rows in _matrix(vectors.mapInArrow(_identities(sent, scale, shift), _PARTS)).items():
        m = models[length]
        s = np.array([high + low for high, low in rows]) / m["n"]
        mean = s[:, -1]
        m["identity_error"] = float(np.abs(s[:, :-1] - np.outer(mean, mean) - np.eye(len(s))).max())
    return models


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, top: int = 32) -> DataFrame:
    """vec_id, n, deviation (decimal), whitened and explained (arrays over components) and identity_error of each row that takes part.

    Components become floor(scale * c) + shift.
    """
    python_ready(rows.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    given = rows.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    models = fit(given.select("v"), scale, shift, top)
    sent = {k: {n: m[n] for n in ("n", "sums", "mean", "frame", "explained", "identity_error")} for k, m in models.items()}
    return given.mapInArrow(_whitened(sent, scale, shift), "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")

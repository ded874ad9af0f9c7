"""Group statistics, ranks and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_biserial(flag: Column, value: Column) -> Column:
    """Correlation of a flag with a value, by the sample deviation; 0 without spread or without both groups. An aggregate."""
    n1, n = F.count_if(flag), F.count(value)
    gap = F.avg(F.when(flag, value)) - F.avg(F.when(~flag, value))
    return F.coalesce(F.try_divide(gap * F.sqrt(n1 * (n - n1) / (n * n)), F.stddev_samp(value)), F.lit(0.0))


def cohens_d(flag: Column, value: Column) -> Column:
    """Difference of means in population deviations of all values; 0 without spread or without both groups. An aggregate."""
    return F.coalesce(F.try_divide(F.avg(F.when(flag, value)) - F.avg(F.when(~flag, value)), F.stddev_pop(value)), F.lit(0.0))


def top_by_count(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """keys, value, n, rank: the k most frequent values of each group, ties by value; counts are made before ranks."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", rank).where(F.col("rank") <= k)


def first_source(df: DataFrame, key: str, priority: list[str]) -> DataFrame:
    """The row of each key that comes first by the priority columns."""
    rest = F.struct(*priority, *[c for c in df.columns if c not in (key, *priority)])
    return df.groupBy(key).agg(F.min(rest).alias("__r")).select(key, "__r.*")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, span_id: str, bucket: int = 64) -> DataFrame:
    """points with the id of the smallest span of the same keys that holds them, ties by id; null if none does.

    A range join by buckets: a span is listed in each bucket it touches, a point looks into one, so the join has equal keys.
    Rows of points must be distinct.
    """
    spans = spans.groupBy(*keys, start, end).agg(F.min(span_id).alias(span_id))  # of equal spans the first id wins everywhere
    b = spans.select(*keys, start, end, span_id, F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("__b"))
    hit = points.withColumn("__b", F.floor(F.col(at) / bucket)).join(b, [*keys, "__b"]).where(F.col(at).between(F.col(start), F.col(end)))
    best = hit.groupBy(*points.columns).agg(F.min_by(span_id, F.struct(F.col(end) - F.col(start), F.col(span_id))).alias(span_id))
    return points.join(best, points.columns, "left")


def first_match(rows: DataFrame, patterns: list[tuple[str, str]], text: Column, out: str) -> DataFrame:
    """rows with the value of the first pattern that the text contains, in table order; null if none does."""
    return rows.withColumn(out, F.coalesce(*[F.when(text.contains(p), F.lit(v)) for p, v in patterns]))


def resolution(expected: DataFrame, status: DataFrame, key: str, test: str) -> DataFrame:
    """key, total, passed, rate over the distinct expected tests (key, test).

    A test passes if status (key, test, status) has it and only as PASSED; tests without a status failed.
    """
    each = status.groupBy(key, test).agg(F.bool_and(F.col("status") == "PASSED").alias("__ok"))
    joined = expected.select(key, test).distinct().join(each, [key, test], "left")
    out = joined.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if("__ok").alias("passed"))
    return out.withColumn("rate", F.round(F.col("passed") / F.col("total"), 6))

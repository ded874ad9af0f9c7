"""Ranks and order statistics of groups of any size: no group is sorted in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def ranged(df: DataFrame, keys: list[str], value: str, weight: str | None = None, parts: int | None = None) -> DataFrame:
    """keys, value, n, __range of the distinct values: n rows (or their weights) have them, and ranges follow each other by keys and value.

    Equal values are counted before anything is sorted, so a value that a third of all rows share is one row. The table is stored, as ranges
    are drawn from a sample and must not be drawn twice. Without parts, the session sizes the ranges. Null values are left out.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    by = [*keys, value]
    cut = counts.repartitionByRange(*by) if parts is None else counts.repartitionByRange(parts, *by)
    return stored(cut.withColumn("__range", F.spark_partition_id()))


def places(df: DataFrame, keys: list[str], value: str, weight: str | None = None, parts: int | None = None) -> DataFrame:
    """keys, value, n, below, total of the distinct values of each group: n rows have the value, below rows a smaller one, total rows any.

    Ranks are running sums within a range, and what lies before a range is a sum of sums, of which a group has one a range. Null keys
    are a group of their own; a group without values has no row.
    """
    cut = ranged(df, keys, value, weight, parts)
    before_this = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, "__range").agg(F.sum("n").alias("__s"))
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    start = sums.select(*[F.col(k).alias(v) for k, v in names.items()], F.col("__range").alias("__r"), F.coalesce(F.sum("__s").over(before_this(group.orderBy("__range"))), F.lit(0)).alias("__before"), F.sum("__s").over(group).alias("total"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()], F.col("__range") == F.col("__r"))
    within = F.coalesce(F.sum("n").over(before_this(Window.partitionBy(*keys, "__range").orderBy(value))), F.lit(0))
    return cut.withColumn("__w", within).join(start, same).select(*keys, value, "n", (F.col("__before") + F.col("__w")).alias("below"), "total")


def medians(df: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """keys, n, median, upper_median of the values that are not null: the mean of the two in the middle as a double, and the upper of them."""
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value)))
    total = F.col("total")
    out = places(df, keys, value, parts=parts).groupBy(*keys).agg(F.max("total").alias("__t"), at(F.floor((total - 1) / 2)).alias("__lo"), at(F.floor(total / 2)).alias("__hi"))
    middle = (F.col("__lo").cast("double") + F.col("__hi").cast("double")) / 2
    return out.select(*keys, F.col("__t").alias("n"), middle.alias("median"), F.col("__hi").alias("upper_median"))


def described(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, median, std (of the sample; 0 for one row) of the values that are not null."""
    known = df.where(F.col(value).isNotNull())
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    moments = known.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std")).withColumnsRenamed(names)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()], F.lit(True))
    return medians(known, keys, value).join(moments, same).select(*keys, "n", "mean", "median", "std")


def average_rank(df: DataFrame, value: str, name: str, keys: list[str], parts: int | None = None) -> DataFrame:
    """df with the rank of the value in its group, ties sharing their mean rank; null for a null value.

    Rows meet the ranks of distinct values by keys and value; where one value has most rows, the adaptive join splits them.
    """
    rank = places(df, keys, value, parts=parts)
    names = {k: f"__k{i}" for i, k in enumerate([*keys, value])}
    small = rank.select(*[F.col(k).alias(v) for k, v in names.items()], (F.col("below") + (F.col("n") + 1) / 2).cast("double").alias(name))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()])
    return df.join(small, same, "left").drop(*names.values())


def spearman(df: DataFrame, x: str, y: str, by: list[str], parts: int | None = None) -> DataFrame:
    """by, n, rho: 1 - 6 sum d^2 / (n (n^2 - 1)) over the rows that have both values, 0 below three of them; ties share their mean rank.

    Equal pairs are counted first, and ranks are looked up for each pair once.
    """
    pairs = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__n")))

    def ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
        names = {k: f"{name}_{i}" for i, k in enumerate([*by, value])}
        r = places(pairs, by, value, "__n", parts).select(*[F.col(k).alias(v) for k, v in names.items()], (F.col("below") + (F.col("n") + 1) / 2).cast("double").alias(name))
        return rows.join(r, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()])).drop(*names.values())

    both = ranks(ranks(pairs, x, "__rx"), y, "__ry")
    n = F.sum("__n")
    d = F.sum(F.col("__n") * (F.col("__rx") - F.col("__ry")) ** 2)
    total = n.cast("double")
    return both.groupBy(*by).agg(n.alias("n"), F.when(n < 3, 0.0).otherwise(1 - 6 * d / (total * (total * total - 1))).alias("rho"))

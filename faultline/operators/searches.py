"""Breadth-first search by joins: what a step finds anew is stored, and what is known already is kept in few tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame

from ..session import stored

#: Tables of known rows before they are written as one.
PARTS = 4


def levels(start: DataFrame, keys: list[str], step: Callable[[DataFrame, int], DataFrame], limit: int | None = None) -> list[DataFrame]:
    """The rows of start, of the first step from them, and so on, each key in the first level that has it; stored tables.

    step(frontier, number) gives rows with the columns of start, one for each key. It is taken limit times at most; without a limit,
    until it finds nothing new. A join a level, whatever came before, as known keys lie in PARTS tables at most.
    """
    out = [stored(start)]
    known = [out[0].select(*keys)]
    for number in count(1) if limit is None else range(1, limit + 1):
        new = step(out[-1], number).join(reduce(DataFrame.unionByName, known), keys, "left_anti")
        new = stored(new.select(*start.columns))
        if new.isEmpty():
            break
        out.append(new)
        known.append(new.select(*keys))
        if len(known) > PARTS:
            known = [one(known)]
    return out


def one(parts: list[DataFrame]) -> DataFrame:
    """The parts as one stored table with no more partitions than a shuffle makes."""
    n = int(parts[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(reduce(DataFrame.unionByName, parts).coalesce(n))


def together(parts: list[DataFrame]) -> DataFrame:
    """The levels as one table. Many are stored in groups first, so that no plan has more than a few branches for long."""
    while len(parts) > PARTS:
        parts = [one(parts[i : i + 4 * PARTS]) for i in range(0, len(parts), 4 * PARTS)]
    return reduce(DataFrame.unionByName, parts)

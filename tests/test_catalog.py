"""Every query of the catalog against its SQL in DuckDB, on whole tables."""

import math

import duckdb
import pytest

from faultline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def same(spark_rows, sql_rows, names, columns):
    order = sorted(range(len(names)), key=names.__getitem__)
    other = sorted(range(len(columns)), key=columns.__getitem__)
    a = sorted((tuple(plain(r[i]) for i in order) for r in spark_rows), key=str)
    b = sorted((tuple(plain(r[i]) for i in other) for r in sql_rows), key=str)
    return a == b, [x for x in zip(a, b, strict=False) if x[0] != x[1]][:3], len(a), len(b)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    ok, diff, n, m = same([list(r) for r in df.collect()], rel.fetchall(), df.columns, rel.columns)
    assert ok, (n, m, diff)
    assert n > 0

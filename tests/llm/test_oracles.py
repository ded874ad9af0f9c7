"""Queries of the subpackage against their SQL, on whole small tables and on rows with nulls, repeats and ties."""

import duckdb
import pytest

from faultline.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}')")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, str(folder))
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
    assert got == want, [x for x in zip(got, want, strict=False) if x[0] != x[1]][:3]
    return got


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and repeated rows, ties and columns of clashing names."""
    d = tmp_path_factory.mktemp("odd")
    words = " ".join(f"w{i}" for i in range(40))
    key = "Zx9Kq2Lm8Wp4Rt6Yv1Bn3Cd5"
    docs = [(1, words, "a"), (2, words + " more", "b"), (3, None, None), (4, "", "a"), (5, " \n\t", "b"), (7, "one", "a"), (8, "x\nx\n\n| # <b>\nx y", None)]
    docs += [(9, f"É token = \"{'ab12' * 10}\" {key} {key}", "a"), (10, f"secret:{key} ghp_{key}", "b"), (11, f"see ghp_{'q' * 30} and {'0f' * 20}", "a"), (12, "a b c d e a b c d e a b c d e", "c")]
    docs += [(k, " ".join(f"v{(k * i) % 23}" for i in range(30)), "big") for k in range(100, 160)]
    spark.createDataFrame([(*r, 1, "t", 2) for r in docs], "doc_id long, text string, source string, tokens int, key string, node int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 1), (None, 1, 0), (101, 1, 0), (500, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vec = lambda k: [float((k * i * i) % 7 - 3) for i in range(1, 17)]
    vs = [(k, vec(k), k % 2) for k in range(1, 15)] + [(20, vec(1), 1), (21, [2 * x for x in vec(1)], 1), (22, None, 1), (23, [0.0] * 16, 1), (24, [float("nan")] * 16, 1), (25, vec(1), None), (26, vec(1)[:8], 1), (27, [], 1)]
    spark.createDataFrame([(*r, 1) for r in vs], "vec_id long, embedding array<float>, label int, node int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert len(same(spark, SF, name)) >= 200


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_odd_rows_match_sql(spark, odd, name):
    assert same(spark, odd, name)

"""Sources and watchers, on small files."""

import json

from pyspark.sql.types import LongType, StringType, StructType

from faultline.sources import records
from faultline.streaming import watch

SCHEMA = StructType().add("instance_id", StringType()).add("n", LongType())


def test_bad_rows_are_set_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"instance_id": "x", "n": 1}\n{"instance_id": "y"}\n{broken\n')
    good, bad = records.load_instances(spark, str(tmp_path), SCHEMA, ["instance_id", "n"])
    assert [tuple(r) for r in good.collect()] == [("x", 1)]
    assert sorted((len(r["missing_fields"]), r["_corrupt_record"] is not None) for r in bad.collect()) == [(1, False), (2, True)]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", None)], "instance_id string, n long")
    records.save_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema(SCHEMA).json(str(tmp_path / "j")).collect())) == [("x", 1), ("y", None)]
    records.save_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    for _ in range(2):
        records.append_usage(df, str(tmp_path / "u"))
    assert spark.read.json(str(tmp_path / "u")).count() == 4
    (tmp_path / "arr.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert records.load_json(spark, str(tmp_path / "arr.json")).count() == 2


def test_directories(spark, tmp_path):
    for name in ("d/x_validation.json", "d/y_validation.json", "d/other.json", "s/p/a.py", "s/.git/b.py", "s/c.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"instance_id": name, "n": 1}, indent=1))
    assert records.load_details(spark, str(tmp_path / "d"), SCHEMA).count() == 2
    assert [r["path"] for r in records.load_sources(spark, str(tmp_path / "s")).collect()] == ["p/a.py"]


def test_each_detail_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    done = spark.createDataFrame([("z",)], "id string")

    def run():
        stream = watch.new_details(spark, str(folder), SCHEMA, done=done)
        watch.drain(stream, str(tmp_path / "cp"), lambda df, _: seen.extend(r["instance_id"] for r in df.collect())).awaitTermination()

    for k in ("x", "y", "z"):
        (folder / f"{k}1.json").write_text(json.dumps({"instance_id": k, "n": 1}))
    run()
    (folder / "x2.json").write_text(json.dumps({"instance_id": "x", "n": 2}))
    (folder / "w.json").write_text(json.dumps({"instance_id": "w", "n": 2}))
    run()
    assert sorted(seen) == ["w", "x", "y"]


def test_usage_and_windows(spark, tmp_path):
    folder = tmp_path / "u"
    folder.mkdir()
    (folder / "a.json").write_text('{"model": "m", "input_tokens": 3, "output_tokens": 1}\n{"model": "m", "input_tokens": 4, "output_tokens": 0}\n')
    query = watch.usage_totals(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("usage_t").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("usage_t").collect()] == [("m", 2, 7, 1)]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 01:00:00", "b")], "ts string, kind string").selectExpr("timestamp(ts) AS ts", "kind")
    assert sorted(r["n"] for r in watch.windowed_counts(events, "ts", "kind").collect()) == [1, 2]

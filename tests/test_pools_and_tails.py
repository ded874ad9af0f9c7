"""Batches that are committed one by one, the ends of large logs, and exact sums of costs."""

import os

import pytest
from pyspark.sql import functions as F

from faultline.operators import reports
from faultline.sources import exports
from faultline.streaming import tail, watch


def test_a_run_that_stops_between_batches(spark, tmp_path):
    """What was finished stays and is not made again; the rest follows in the next run, with new hashes after it."""
    folder, made = str(tmp_path / "pool"), []
    new = spark.createDataFrame([(f"h{k:02}", f"code {k}") for k in range(17)] + [("h03", "code 3"), (None, "x")], "hash string, code string")

    def vectors(rows):
        made.append(sorted(r.hash for r in rows.collect()))
        if len(made) == 3:
            raise RuntimeError("stopped")
        return rows.select("hash", F.array(F.length("code").cast("double")).alias("v"))

    with pytest.raises(RuntimeError, match="stopped"):
        exports.save_pool(new, folder, 5, vectors)
    assert made == [[f"h{k:02}" for k in range(5 * b, 5 * b + 5)] for b in range(3)]
    assert sorted(r.hash for r in exports.load_pool(spark, folder).collect()) == [f"h{k:02}" for k in range(10)]
    more = new.unionByName(spark.createDataFrame([("a1", "z"), ("a2", "z")], "hash string, code string"))
    made.extend([None])  # past the failing call
    assert exports.save_pool(more, folder, 5, vectors) == 3
    assert made[4:] == [[f"h{k:02}" for k in range(10, 15)], ["h15", "h16"], ["a1", "a2"]]
    rows = exports.load_pool(spark, folder).collect()
    assert len(rows) == len({r.hash for r in rows}) == 19 and exports.save_pool(more, folder, 5, vectors) == 0
    assert exports.save_pool(new.limit(0), str(tmp_path / "none")) == 0


def test_the_end_of_a_large_log(spark, tmp_path):
    """A sparse file of 5 GB: only its end is read."""
    big, small = tmp_path / "big.log", tmp_path / "small.log"
    with open(big, "wb") as f:
        f.write(b"Stage 1 begins\n")
        f.seek(5_000_000_000)
        f.write(b"\xff the end: Stage 3 begins\n")
    small.write_text("Stage 1 begins\n")
    rows = {os.path.basename(r.path): r for r in tail.tails(spark, [str(big), str(small)], 1000).collect()}
    assert rows["big.log"].size == 5_000_000_026 and len(rows["big.log"].tail.encode()) < 1010 and rows["big.log"].tail.endswith("Stage 3 begins\n")
    assert rows["small.log"].tail == "Stage 1 begins\n"
    assert watch.ends_with_marker(spark, str(big), "Stage 3 begins") and not watch.ends_with_marker(spark, str(big), "Stage 1 begins")


def test_costs_do_not_depend_on_partitions(spark):
    rows = [(f"m{k % 3}", 7 * k + 1, k, k % 5, k % 4, f"t{k}") for k in range(2000)]
    df = spark.createDataFrame(rows, "model string, input_tokens long, output_tokens long, cache_write long, cache_read long, timestamp string")
    rates = spark.createDataFrame([(0, "m1", 0.1, 0.3, 0.7, 1.1)], "ord int, name string, input double, cache_write double, cache_read double, output double")
    found = [sorted(map(str, reports.usage_costs(df.repartition(n), rates).collect())) for n in (1, 4, 211)]
    assert found[0] == found[1] == found[2]
    m1 = sum(max(0, i - w - r) * 0.1 + w * 0.3 + r * 0.7 + o * 1.1 for m, i, o, w, r, _ in rows if m == "m1") / 1e6
    assert reports.usage_costs(df, rates).where("model = 'm1'").first().cost == pytest.approx(m1, abs=1e-6)

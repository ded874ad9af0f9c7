"""The reports of a run, written and read again; the best file of an instance."""

from pyspark.sql import functions as F

from faultline.sources import report_set

DEFECTS = "instance_id string, seed_id string, repo string, fix_intent string, problem_statement string, patch string, chain array<string>, injection_patch string, test_case_code string, injection_strategy string, status string, is_valid boolean"


def tables(spark):
    seeds = spark.createDataFrame([("s1", "m1"), ("s2", "m2"), ("s3", None)], "instance_id string, metadata string")
    chains = spark.createDataFrame([("c1", "s1", "r", "A", ["a", "b", "c"]), ("c2", "s2", None, "", []), ("c3", "s2", "r", None, None)], "chain_id string, instance_id string, repo string, fix_intent string, nodes array<string>")
    defects = spark.createDataFrame([("d1", "s1", "r", "A", "text", "p", ["a", "b"], None, "code", "x", "valid", True), ("d2", "s1", "r", None, None, None, None, "ip", None, None, None, None), ("d3", "gone", "r", "B", "", "", [], "", "", "", "invalid", False)], DEFECTS)
    return seeds, chains, defects


def test_written_and_read(spark, tmp_path):
    report_set.save_report_set(*tables(spark), str(tmp_path))
    chains = {r.chain_id: r for r in spark.read.json(f"{tmp_path}/1_extraction/summary").collect()}
    assert (chains["c1"].path_length, chains["c1"].symptom_node, chains["c1"].root_cause_node, chains["c1"].fix_intents) == (3, "a", "c", ["A"])
    assert (chains["c2"].path_length, chains["c2"].symptom_node, chains["c2"].repo, chains["c2"].fix_intents) == (0, "N/A", "Unknown", ["Unknown"])
    assert (chains["c3"].path_length, chains["c3"].root_cause_node, chains["c3"].fix_intents) == (0, "N/A", [])
    made = {r.synthetic_instance_id: r for r in spark.read.json(f"{tmp_path}/2_synthesis/summary").collect()}
    assert (made["d1"].seed_metadata, made["d1"].synthetic_chain_depth, made["d1"].validation_status, made["d1"].is_valid_bug, made["d1"].synthetic_injection_patch) == ("m1", 2, "valid", True, "")
    assert (made["d2"].synthetic_chain_depth, made["d2"].validation_status, made["d2"].is_valid_bug) == (0, "skipped", False)
    assert made["d3"].seed_metadata is None and len(made) == 3
    data = {r.instance_id: r.metadata for r in spark.read.json(f"{tmp_path}/2_synthesis/final_dataset").collect()}
    assert data["d1"].is_synthetic and data["d1"].synthetic_chain == ["a", "b"] and data["d2"].synthetic_injection_patch == "ip"
    assert spark.read.json(f"{tmp_path}/report").collect()[0].asDict() == {"total_input_instances": 3, "total_extracted_chains": 3, "total_synthetic_instances": 3, "seeds_with_synthetic": 2, "seed_coverage_rate": "66.7%", "avg_synthetic_per_seed": 1.0}


def test_report_of_an_empty_run(spark):
    none = [t.where("false") for t in tables(spark)]
    assert [tuple(r) for r in report_set.run_report(*none).collect()] == [(0, 0, 0, 0, "0.0%", 0.0)]
    assert report_set.synthesis_summaries(none[2], none[0]).collect() == []


def test_best_files(spark):
    rows = [("x/a_rank10.json", 5), ("x/a_rank2.json", 1), ("x/a_rank2.txt", 9), ("y/a_rank2.json", 3), ("x/b.json", 1), ("y/b.json", 1), ("x/c_rank1000000.json", 1), ("x/c.json", 1), ("x/d_rank1_rank3.json", 1), ("x/e_rank" + "9" * 60 + ".json", 1)]
    files = spark.createDataFrame(rows, "path string, t long").select("path", F.timestamp_seconds("t").alias("mtime"))
    got = {r.instance_id: (r.rank, r.path) for r in report_set.best_details(files).collect()}
    assert got["a"] == (2, "y/a_rank2.json") and got["b"] == (999_999, "x/b.json") and got["d_rank1"] == (3, "x/d_rank1_rank3.json")
    assert got["e"][0] == (1 << 63) - 1
    # a file without a rank has the place of rank 999,999, as a number beyond it comes later
    assert got["c"] == (999_999, "x/c.json")

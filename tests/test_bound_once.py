"""What a row function reads more than once is computed once a row, and rows of a small file reach all cores."""

import time

from pyspark.sql import functions as F

from faultline.functions import answers, chains, gates, injection, logs, problem_texts
from faultline.plans import catalog

SF = "/root/testdata/sf0.001"


def times(df, word):
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def outputs(spark):
    return spark.createDataFrame([("x",)], "output string").select(F.concat("output", F.lit("!")).alias("output"))


def test_trace_alignment_reads_its_columns_once(spark):
    frame = "struct<file_path:string,function:string,code:string>"
    rows = spark.createDataFrame([(["a.py:f", "b.py:g"], "b.py:g", [[("a.py", "f", "x"), ("b.py", "g", "y")]])], f"chain array<string>, target string, traces array<array<{frame}>>")
    found = rows.select(chains.trace_alignment(F.col("chain"), F.col("target"), F.col("traces")).alias("s"))
    assert times(found, "target#") <= 4 and times(found, "chain#") <= 4
    assert found.first().s.asDict() == {"trace_coverage": 1.0, "matched_nodes": ["a.py:f", "b.py:g"], "total_nodes": 2, "target_hit": True, "causal_ordering": 1.0, "overall": 1.0}


def test_failure_mode_runs_each_regex_once(spark):
    assert times(outputs(spark).select(logs.failure_mode(F.col("output")).alias("x")), "regexp_extract_all(") == 3


def test_frames_and_outputs_run_each_regex_once(spark):
    assert times(outputs(spark).select(logs.traceback_of(F.col("output"), F.lit("t")).alias("x")), "regexp_extract_all(") == 4
    assert times(outputs(spark).select(logs.parsed_output(F.col("output")).alias("x")), "regexp_extract_all(") == 4


def test_texts_read_an_output_once(spark):
    parsed = outputs(spark).select(logs.parsed_output(F.col("output")).alias("p"))
    assert times(parsed.select(problem_texts.hybrid_text(F.lit("a b."), F.col("p"), "standard", F.lit("r")).alias("x")), "regexp_extract_all(") == 4
    assert times(parsed.select(problem_texts.informed_text(F.lit(0.5), F.lit("a b."), F.col("p"), F.lit("r")).alias("x")), "regexp_extract_all(") == 4


def test_a_snippet_is_split_once(spark):
    assert times(outputs(spark).select(answers.locate(F.col("output"), F.lit("a\nb"), F.length("output")).alias("x")), "split(") == 1


def test_points_and_refusals_are_found_once(spark):
    edit = F.struct(F.lit("").alias("old"), F.lit("").alias("new"))
    found = outputs(spark).select(injection.compatibility(F.col("output"), F.col("output"), F.col("output"), F.col("output"), edit).alias("x"))
    assert times(found, "exception_handler") == 1
    assert times(outputs(spark).select(gates.text_refusal(F.col("output"), F.lit("standard")).alias("x")), "fix(?:ed)?") == 1


def test_a_long_sentence_is_cleaned_in_one_pass(spark):
    text = "Nothing else. The fix is " + "word " * 6000
    start = time.time()
    row = spark.createDataFrame([(text,)], "t string").select(gates.sanitized(F.col("t"), F.lit(""), F.lit("")).alias("x")).first()
    assert row.x == "Nothing else."
    assert time.time() - start < 10


def test_rows_of_a_small_file_reach_all_cores(spark):
    for name in ("failure_modes", "located_snippets", "sanitized_texts", "seed_patterns", "patch_refusals", "built_patches"):
        assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name

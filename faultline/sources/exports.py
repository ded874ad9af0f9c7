"""Standard forms of instances, checkpointed and incremental writers, graphs and pools as tables, and small report texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

#: The fields of a standard instance, and those of them that each must have.
STANDARD = ("instance_id", "repo", "base_commit", "problem_statement", "hints_text", "created_at", "version", "FAIL_TO_PASS", "PASS_TO_PASS", "environment_setup_commit", "patch", "test_patch")
REQUIRED = ("instance_id", "repo", "base_commit", "problem_statement", "created_at", "version", "FAIL_TO_PASS", "PASS_TO_PASS", "patch")


def standard(instances: DataFrame, synthetic_only: bool = True) -> DataFrame:
    """The standard fields of instances, of synthetic ones alone (column synthetic) unless told otherwise."""
    rows = instances.where("synthetic") if synthetic_only else instances
    return rows.select(*STANDARD)


def invalid_rows(instances: DataFrame) -> DataFrame:
    """instance_id and the required fields it lacks, of rows that lack some."""
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    return instances.select("instance_id", lacks.alias("missing_fields")).where(F.size("missing_fields") > 0)


def exported(synthesis: DataFrame) -> DataFrame:
    """Synthetic defects (instance_id, repo, base_commit, problem_statement, patch, test_patch, fail, keep, seed_id, fix_intent, chain) in the standard form with their metadata as JSON."""
    depth = F.size(F.coalesce("chain", F.array().cast("array<string>")))
    meta = F.to_json(F.struct(F.lit(True).alias("is_synthetic"), "seed_id", F.col("fix_intent").alias("seed_fix_intent"), F.col("chain").alias("synthesized_chain"), depth.alias("chain_depth"), F.greatest(depth - 1, F.lit(0)).alias("chain_length")))
    return synthesis.select("instance_id", "repo", "base_commit", "problem_statement", "patch", "test_patch", F.to_json("fail").alias("FAIL_TO_PASS"), F.to_json("keep").alias("PASS_TO_PASS"), F.lit("synthetic_v1").alias("version"), meta.alias("metadata"))


def located_instances(spark: SparkSession, path: str, first: int = 10) -> DataFrame:
    """The first instances by file order of a file of JSON lines with localizations; lines that do not parse or lack a needed field are passed over."""
    meta = "struct<repo:string,base_commit:string,patch:string,test_patch:string,problem_statement:string,hints_text:string,created_at:string,version:string,FAIL_TO_PASS:string,PASS_TO_PASS:string>"
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.from_json("value", f"instance_id string, meta_data {meta}, found_files array<string>, found_modules array<string>, found_entities array<string>").alias("r"))
    good = rows.where("r.instance_id is not null and r.meta_data.repo is not null and r.meta_data.base_commit is not null and r.meta_data.patch is not null and r.meta_data.problem_statement is not null")
    none, text = F.array().cast("array<string>"), lambda c, other="": F.coalesce(F.col(f"r.meta_data.{c}"), F.lit(other)).alias(c)
    out = good.orderBy("n").limit(first)
    return out.select("r.meta_data.repo", "r.instance_id", "r.meta_data.base_commit", "r.meta_data.patch", text("test_patch"), "r.meta_data.problem_statement", text("hints_text"), text("created_at"), text("version"), text("FAIL_TO_PASS", "[]"), text("PASS_TO_PASS", "[]"), *[F.coalesce(f"r.{c}", none).alias(c) for c in ("found_files", "found_modules", "found_entities")])


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A code graph as two tables, partitioned by graph; other graphs of the folder stay."""
    for df, name in ((nodes, "nodes"), (edges, "edges")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph").parquet(f"{folder}/{name}")


def load_graph(spark: SparkSession, folder: str, graph: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of save_graph, of one graph if it is named (only its partition is read)."""
    out = [spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "edges")]
    return tuple(x if graph is None else x.where(F.col("graph") == graph) for x in out)  # type: ignore[return-value]


def chosen_pools(asked: DataFrame, pools: DataFrame) -> DataFrame:
    """asked(repo, commit) with the pool that serves it: of the commit's first eight characters, of the whole commit, the newest of the repository, in the new form before the old; null without one.

    pools: pool, repo, commit, version (2 or 1), mtime.
    """
    order = F.struct((-F.col("version")).alias("v"))
    # any pool serves its repository, so none but those of its newest form are chosen: that of the commit by equal keys, else the newest one
    named = pools.where("pool is not null").withColumn("v", order)
    top = named.groupBy("repo").agg(F.min("v").alias("v"), F.min(F.struct("v", (-F.unix_micros("mtime")).alias("t"), "pool")).alias("newest")).select("repo", "v", F.col("newest.pool").alias("__newest"))
    own = named.join(top.select("repo", "v"), ["repo", "v"], "left_semi").groupBy("repo", "commit").agg(F.min("pool").alias("own"))
    rows = asked.select("repo", "commit").distinct().join(top.drop("v"), "repo", "left")
    for name, key in (("__short", F.substring("commit", 1, 8)), ("__whole", F.col("commit"))):
        rows = rows.withColumn("__key", key).join(own.select("repo", F.col("commit").alias("__key"), F.col("own").alias(name)), ["repo", "__key"], "left").drop("__key")
    return rows.select("repo", "commit", F.coalesce("__short", "__whole", "__newest").alias("pool"))


def pool_of_ids(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """The old form of a pool: ids(position, node) and vectors(position, v) aligned by position."""
    return ids.join(vectors, "position").select("node", "v")


def _known(spark: SparkSession, path: str, column: str) -> DataFrame | None:
    """One column of a table, or None if nothing was written there yet."""
    try:
        return spark.read.parquet(path).select(column)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def save_pool(new: DataFrame, folder: str, batch: int = 500, vectors: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Adds the vectors of new hashes to a pool in batches of `batch` hashes, each committed alone. The number of batches that were added.

    new: hash and what a vector is made of; vectors gives (hash, v) of such rows, the rows themselves without it. The batches of a run are laid down first: a
    table of the hashes that are neither in the pool nor laid down, each with the number of its batch. Then each batch is made, written to a
    folder of its own and entered in the list of finished ones. A run that was stopped leaves finished batches, which load_pool() reads, and
    the next run takes up the others: neither is made again, and rows of a batch that was not entered are written anew.
    """
    spark = new.sparkSession
    plan, done = f"{folder}/plan", f"{folder}/done"
    planned, fresh = _known(spark, plan, "hash"), new.where("hash is not null").select("hash").distinct()
    if planned is not None:
        fresh = fresh.join(planned, "hash", "left_anti")
    fresh = stored(fresh)
    n = fresh.count()
    if n:
        last = -1 if planned is None else spark.read.parquet(plan).agg(F.max("batch")).first()[0]
        # places by ranges: each part of the ordered hashes counts its own, and starts where the parts before it end
        parts = stored(fresh.repartitionByRange(max(1, -(-n // 100_000)), "hash").withColumn("part", F.spark_partition_id()))
        sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
        start, rows = 0, []
        for part in sorted(sizes):
            rows.append((part, start))
            start += sizes[part]
        place = F.row_number().over(Window.partitionBy("part").orderBy("hash")) - 1 + F.col("start")
        numbered = parts.join(F.broadcast(spark.createDataFrame(rows, "part int, start long")), "part").select("hash", (F.floor(place / batch) + last + 1).cast("long").alias("batch"))
        numbered.write.mode("append").parquet(plan)
    if n == 0 and planned is None:
        return 0
    whole = spark.read.parquet(plan)
    finished = _known(spark, done, "batch")
    waiting = whole.select("batch").distinct()
    waiting = waiting if finished is None else waiting.join(finished, "batch", "left_anti")
    numbers = sorted(r.batch for r in waiting.collect())  # a number for each 500 hashes
    for number in numbers:
        rows_of = new.join(whole.where(F.col("batch") == number).select("hash"), "hash", "left_semi").dropDuplicates(["hash"])
        (rows_of if vectors is None else vectors(rows_of)).write.mode("overwrite").parquet(f"{folder}/vectors/batch={number}")
        spark.range(1).select(F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(done)
    return len(numbers)


def load_pool(spark: SparkSession, folder: str) -> DataFrame:
    """hash and v of the finished batches of a pool."""
    return spark.read.parquet(f"{folder}/vectors").join(spark.read.parquet(f"{folder}/done").distinct(), "batch", "left_semi").drop("batch")


def save_each(rows: DataFrame, folder: str, key: str) -> None:
    """Results by key, so that one instance can be written again without the others: a partition each, overwritten alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(folder)


def level_files(texts: DataFrame, folder: str) -> None:
    """Instances with a problem text a level (level, instance_id, problem_statement, ...), a folder of JSON lines a level."""
    texts.write.mode("overwrite").partitionBy("level").json(folder)


def shell_quoted(text: Column) -> Column:
    """A text as one word of a shell command."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


def tool_instances(instances: DataFrame, prefix: str) -> DataFrame:
    """Instances for an agent tool: id, image, problem text and the command that applies the patch; instances: instance_id, problem_statement, patch."""
    image = F.concat(F.lit(prefix), F.lower(F.replace("instance_id", F.lit("__"), F.lit("_1776_"))), F.lit(":latest"))
    return instances.select("instance_id", image.alias("image_name"), "problem_statement", F.concat(F.lit("printf %s "), shell_quoted(F.col("patch")), F.lit(" | git apply -")).alias("setup"))


def latex_table(rows: DataFrame, columns: list[str], caption: str, limit: int = 200) -> str:
    """A small table as LaTeX text; rows beyond the limit are an error, as a report table is small by design."""
    found = rows.select(*columns).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows are no table for a report")
    escape = lambda x: "--" if x is None else str(x).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&").replace("#", r"\#")
    lines = [" & ".join(map(escape, columns)) + r" \\", r"\midrule", *[" & ".join(map(escape, r)) + r" \\" for r in found]]
    return "\n".join([r"\begin{table}[t]", rf"\caption{{{escape(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", *lines, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def shuffled(rows: DataFrame, key: str, seed: int, k: int | None = None) -> DataFrame:
    """rows in the order of a hash of their key and a seed, the first k if asked: a sample that comes out alike in every run."""
    out = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return out if k is None else out.limit(k)


def filled_sample(nodes: DataFrame, relevant: Column, most: int = 15, total: int = 20, by: str = "graph") -> DataFrame:
    """For each graph up to `most` relevant nodes by name, filled up with others to `total`."""
    w = Window.partitionBy(by).orderBy("node")
    marked = nodes.withColumn("__r", F.coalesce(relevant, F.lit(False)))
    near = marked.where("__r").withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    far = marked.where("not __r").withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= total)
    order = Window.partitionBy(by).orderBy(F.desc("__r"), "node")
    return near.unionByName(far).withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= total).select(*nodes.columns)

"""Instance files, directories of per-row JSON, vector pools and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def load_json(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A JSON file that holds one object or an array of them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def load_instances(spark: SparkSession, path: str, schema: StructType, required: list[str], lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema and have all required fields, and the others with their file and the raw row if it does not parse."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", not lines).json(path).withColumn("__file", F.col("_metadata.file_path"))
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    rows = rows.withColumn("missing_fields", lacks)
    good = F.col(CORRUPT).isNull() & (F.size("missing_fields") == 0)
    return rows.where(good).drop(CORRUPT, "missing_fields", "__file"), rows.where(~good).select(F.col("__file").alias("file"), "missing_fields", CORRUPT)


def load_details(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*_validation.json") -> DataFrame:
    """Every matching file of a directory tree as one row, with file and mtime."""
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return reader.json(folder).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"))


def load_sources(spark: SparkSession, folder: str, skip: tuple[str, ...] = (".git", "node_modules", "__pycache__"), suffix: str = ".py") -> DataFrame:
    """path (below folder) and content of each source file outside the skipped folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder)
    below = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    skipped = F.arrays_overlap(F.split(below, "/"), F.array(*[F.lit(x) for x in skip]))
    return files.where(~skipped).select(below.alias("path"), F.decode("content", "UTF-8").alias("content"))


def pool_vectors(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Node vectors: nodes(node_id, hash) with vectors(hash, vector), one row a hash."""
    return nodes.join(vectors.dropDuplicates(["hash"]), "hash").select("node_id", "vector")


def save_json(df: DataFrame, path: str) -> None:
    """Lines of JSON; the committer shows the result only when it is whole."""
    df.write.mode("overwrite").json(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_usage(df: DataFrame, path: str) -> None:
    """Usage records are only ever added."""
    df.write.mode("append").json(path)

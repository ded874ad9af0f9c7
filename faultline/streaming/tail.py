"""The end of large text files as a table, read by an offset: a Python data source named log_tail."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

#: Fixed value: so many bytes of the end of a log are looked at.
TAIL_BYTES = 256_000


class LogTail(DataSource):
    """path, size, tail: the last bytes (option bytes) of each file (option paths, one a line), as text; bytes that are no UTF-8 are replaced."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, size long, tail string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.most = int(options.get("bytes", TAIL_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        """A file is opened through Arrow's file systems, so that any store it knows can be read; nothing but its end is."""
        store, path = pyarrow.fs.FileSystem.from_uri(partition.value if "://" in partition.value else f"file://{partition.value}")
        with store.open_input_file(path) as f:
            size = f.size()
            f.seek(max(0, size - self.most))
            tail = f.read(self.most)
        yield partition.value, size, tail.decode("utf-8", "replace")


def tails(spark: SparkSession, paths: list[str], most: int = TAIL_BYTES) -> DataFrame:
    """path, size and tail of files; a task a file, which reads `most` bytes of it whatever its size."""
    ship(spark)
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").option("paths", "\n".join(paths)).option("bytes", most).load()

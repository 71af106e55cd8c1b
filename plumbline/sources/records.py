"""Raw records of question-answering datasets as a data source: files in order, and no more of them than asked for.

``spark.read.format("records").option("path", folder).option("limit", n)``
reads the first n records of the JSON-lines and Parquet files of a folder, in
order of the files' names.  The limit is known to the reader: files are counted
in order (Parquet by its footers, JSON by its lines) until there are enough
records, each file is a partition of its own with the number of records to take
from it, and no later file is opened.  So a limit needs neither a shuffle nor a
single task that all rows go through.

For folders that all executors see as files.  Other stores are read by Spark's
own readers and ``limit``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ENDINGS = (".parquet", ".jsonl", ".json")
#: Records that a batch has at most.
BATCH = 4096


def files(path: str) -> list[str]:
    """The record files of a folder in order of their names, or the one file."""
    path = path.removeprefix("file://")
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ENDINGS) and not f.startswith(("_", ".")))


def count(path: str, most: int | None = None) -> int:
    """Records of a file; of JSON lines no more than ``most`` are looked at."""
    if path.endswith(".parquet"):
        return pq.read_metadata(path).num_rows
    n = 0
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                n += 1
                if n == most:
                    break
    return n


@dataclass
class File(InputPartition):
    """A file, and how many of its first records are wanted (None: all)."""

    path: str
    take: int | None


class RecordsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.path = to_arrow_schema(schema), options["path"]
        self.limit = int(options["limit"]) if "limit" in options else None
        if self.limit is not None and self.limit < 0:
            raise ValueError(f"limit must not be negative, as {self.limit} is")

    def partitions(self) -> list[File]:
        if self.limit is None:
            return [File(f, None) for f in files(self.path)] or [File("", 0)]
        out, left = [], self.limit
        for f in files(self.path):
            if not left:
                break
            n = min(left, count(f, left))
            out.append(File(f, n))
            left -= n
        return out or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        left = partition.take
        if left == 0:
            return
        for table in self._batches(partition.path):
            if left is not None:
                table = table.slice(0, left)
                left -= table.num_rows
            yield from table.to_batches()
            if left == 0:
                return

    def _batches(self, path: str) -> Iterator[pa.Table]:
        if path.endswith(".parquet"):
            with pq.ParquetFile(path) as f:
                names = [n for n in self.schema.names if n in f.schema_arrow.names]
                for batch in f.iter_batches(BATCH, columns=names):
                    yield self._shaped(pa.Table.from_batches([batch]))
            return
        with open(path, encoding="utf-8") as f:
            held: list[dict] = []
            for line in f:
                if line.strip():
                    held.append(json.loads(line))
                if len(held) == BATCH:
                    yield pa.Table.from_pylist(held, self.schema)
                    held = []
            if held:
                yield pa.Table.from_pylist(held, self.schema)

    def _shaped(self, table: pa.Table) -> pa.Table:
        """The columns of the schema, null where the file has none."""
        columns = [table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in self.schema]
        return pa.Table.from_arrays(columns, schema=self.schema)


class Records(DataSource):
    """The data source; the schema is that of the first file unless it is given."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        known = files(self.options["path"])
        if not known:
            raise ValueError(f"there are no records below {self.options['path']}")
        if known[0].endswith(".parquet"):
            found = pq.read_schema(known[0])
        else:
            with open(known[0], encoding="utf-8") as f:
                found = pa.Table.from_pylist([json.loads(line) for _, line in zip(range(BATCH), f, strict=False) if line.strip()]).schema
        return from_arrow_schema(found)

    def reader(self, schema: StructType) -> RecordsReader:
        return RecordsReader(schema, self.options)


def first_records(spark: SparkSession, path: str, n: int, schema: StructType | None = None) -> DataFrame:
    """The first ``n`` records below ``path``, by as few files as have them."""
    spark.dataSource.register(Records)
    read = spark.read.format("records").option("path", path).option("limit", str(n))
    return (read.schema(schema) if schema is not None else read).load()

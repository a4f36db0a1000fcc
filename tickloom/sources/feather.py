"""Feather V2 (Arrow IPC) files as a Spark data source.

``spark.read.format("feather").option("path", p).option("columns", "a,b").load()`` reads one partition
for each record batch; ``row_seq`` numbers the rows of a file as they lie in it. The reader has no hook for
column pruning, so the columns wanted are an option.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType


def _input(path: str):
    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return pa.memory_map(path)


def _open(path: str, fields: list[int] | None = None) -> ipc.RecordBatchFileReader:
    """fields: places of the columns that are decoded, all if None."""
    options = ipc.IpcReadOptions(included_fields=fields) if fields else ipc.IpcReadOptions()
    return ipc.open_file(_input(path), options=options)


def _places(path: str, names: list[str]) -> list[int]:
    """Places of columns in the file; an error if one is unknown."""
    with _open(path) as f:
        have = f.schema.names
    if unknown := [n for n in names if n not in have]:
        raise ValueError(f"no such columns: {unknown}")
    return [have.index(n) for n in names]


def file_digest(path: str, piece: int = 1 << 24) -> str:
    """A digest of a file's bytes, read a piece at a time."""
    h = hashlib.blake2b(digest_size=16)
    with _input(path) as f:
        while data := f.read(piece):
            h.update(data)
    return h.hexdigest()


class BatchPartition(InputPartition):
    def __init__(self, index: int, first: int):
        super().__init__(index)
        self.index, self.first = index, first


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names
        self.fields = sorted(_places(path, [n for n in self.names if n != "row_seq"]))

    def partitions(self) -> list[InputPartition]:
        """One for each batch, with the place of its first row; a single column is decoded to count rows."""
        first, out = 0, []
        with _open(self.path, self.fields[:1] or [0]) as f:
            for k in range(f.num_record_batches):
                out.append(BatchPartition(k, first))
                first += f.get_batch(k).num_rows
        return out

    def read(self, partition: BatchPartition) -> Iterator[pa.RecordBatch]:
        with _open(self.path, self.fields or [0]) as f:
            batch = f.get_batch(partition.index)
            rows = pa.array(np.arange(partition.first, partition.first + batch.num_rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([rows if n == "row_seq" else batch.column(n) for n in self.names], self.names)


class FeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as f:
            full = from_arrow_schema(f.schema)
        wanted = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else full.names
        if unknown := [c for c in wanted if c not in full.names]:
            raise ValueError(f"no such columns: {unknown}")
        return StructType([*(full[c] for c in wanted), StructField("row_seq", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeatherReader(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatherSource)


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None):
    register(spark)
    reader = spark.read.format("feather").option("path", path)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


class MappedFeather:
    """A file held open for reading columns without Spark; closed, it refuses."""

    def __init__(self, path: str):
        self.path, self.file = path, _open(path)

    def _held(self) -> ipc.RecordBatchFileReader:
        if self.file is None:
            raise RuntimeError("the file is closed")
        return self.file

    @property
    def schema(self) -> pa.Schema:
        return self._held().schema

    def read_columns(self, names: list[str]) -> pa.Table:
        """Only these columns are decoded."""
        self._held()
        with _open(self.path, sorted(_places(self.path, names))) as f:
            return f.read_all().select(names)

    def close(self) -> None:
        if self.file is not None:
            self.file.__exit__(None, None, None)
        self.file = None

    def __enter__(self) -> MappedFeather:
        return self

    def __exit__(self, *_) -> None:
        self.close()

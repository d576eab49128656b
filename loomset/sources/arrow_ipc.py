"""Shards of Arrow IPC files as a Python data source: one partition a file, batch by batch."""

from __future__ import annotations

import glob
import os

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

_WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.large_binary(): pa.binary(), pa.large_string(): pa.string()}


def widened(schema: pa.Schema) -> pa.Schema:
    """The schema with types that Spark takes."""
    return pa.schema([pa.field(f.name, _WIDER.get(f.type, f.type), f.nullable) for f in schema])


def _open(path: str):
    source = pa.memory_map(path)
    try:
        return pa.ipc.open_file(source)
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(pa.memory_map(path))


def _paths(path: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(path, "*.arrow")) if os.path.isdir(path) else glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


class Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArrowShards(DataSource):
    """``spark.read.format("arrow_shards").load(folder or pattern)``"""

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def schema(self) -> StructType:
        return from_arrow_schema(widened(_open(_paths(self.options["path"])[0]).schema))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowShardReader(self.options["path"])


class ArrowShardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Shard(p) for p in _paths(self.path)]

    def read(self, partition):
        reader = _open(partition.path)
        target = widened(reader.schema)
        some = (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else iter(reader)
        for b in some:
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, target, strict=True)], schema=target)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowShards)


def write_shards(batches, path: str, schema: pa.Schema, shard_bytes: int | None = None) -> list[int]:
    """Write batches as Arrow files of about ``shard_bytes`` each, closed after the batch that reaches it; returns the rows of each."""
    os.makedirs(path)
    counts, writer, filled = [], None, 0
    for b in batches:
        if writer is None:
            writer, filled = pa.ipc.new_file(os.path.join(path, f"shard-{len(counts):05d}.arrow"), schema), 0
            counts.append(0)
        writer.write_batch(b)
        counts[-1] += b.num_rows
        filled += b.nbytes
        if shard_bytes is not None and filled >= shard_bytes:
            writer.close()
            writer = None
    if writer is not None:
        writer.close()
    return counts

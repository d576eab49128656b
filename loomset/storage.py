"""Sharded tables with a manifest: write, publish, validate, open."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset import features
from loomset.operators.selection import with_positions
from loomset.session import checkpointed

ROW, SHARD, VERSION, MANIFEST = "__row_id", "__shard_id", 1, "_manifest.json"


def shard_of_batches(sizes: DataFrame, target: int, batch: str = "batch", size: str = "b") -> DataFrame:
    """``sizes`` with a shard for each batch: a shard closes once its batches reach ``target`` bytes.

    The rule resets with every shard, so it is no window function. The sizes, two numbers for thousands of data rows, stream in order
    through one task, which jumps from shard to shard and gives only each shard's first batch; batches find theirs among these.
    """

    def cut(batches):
        shard, filled, start = 0, 0, True
        for b in batches:
            at, cum = b.column(0).to_numpy(), np.cumsum(b.column(1).to_numpy())
            firsts, i, before = [], 0, 0
            while i < len(at):
                if start:
                    firsts.append((shard, int(at[i])))
                # the first batch at which the open shard reaches the target
                j = int(np.searchsorted(cum, target - filled + before, "left"))
                start = j < len(at)
                if start:
                    shard, filled, before, i = shard + 1, 0, cum[j], j + 1
                else:
                    filled, i = filled + int(cum[-1] - before), len(at)
            yield pa.RecordBatch.from_pylist([{"shard": s, "first": f} for s, f in firsts], schema=pa.schema([("shard", pa.int64()), ("first", pa.int64())]))

    narrow = sizes.select(F.col(batch).cast("long"), F.coalesce(F.col(size), F.lit(0)).cast("long"))
    firsts = checkpointed(narrow.repartition(1).sortWithinPartitions(batch).mapInArrow(cut, "shard bigint, first bigint"))
    starts = np.array([r["first"] for r in firsts.orderBy("shard").toLocalIterator()], np.int64)  # a number a shard
    shared = sizes.sparkSession.sparkContext.broadcast(starts)

    @F.arrow_udf("bigint")
    def shard_of(at: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, at.to_numpy(zero_copy_only=False), "right") - 1)

    return sizes.withColumn("shard", shard_of(F.col(batch).cast("long")))


def write(df: DataFrame, path: str, *, order: list | None = None, drop: list = (), batch_size: int = 1000, shard_bytes: int | None = None, compression: str = "zstd", lineage: dict | None = None) -> dict:
    """Write ``df`` as shards under ``path`` with dense row ids in ``order``, publish it in one rename, return the manifest.

    Works on folders that this process can rename, as on a shared mount; an existing table at ``path`` is an error.
    """
    if Path(path).exists():
        raise FileExistsError(path)
    rows = with_positions(df, *(order or []), name=ROW).drop(*drop)
    df = df.drop(*drop)
    if shard_bytes is None:
        rows = rows.withColumn(SHARD, F.lit(0).cast("long"))
    else:
        width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
        sizes = rows.groupBy(F.floor(F.col(ROW) / batch_size).alias("batch")).agg(F.sum(width).alias("b"))
        shards = shard_of_batches(sizes, shard_bytes).select("batch", F.col("shard").alias(SHARD))
        rows = rows.withColumn("batch", F.floor(F.col(ROW) / batch_size)).join(shards, "batch").drop("batch")
    staging = f"{path}.{uuid.uuid4().hex}.tmp"
    rows.repartitionByRange(SHARD, ROW).sortWithinPartitions(ROW).write.partitionBy(SHARD).option("compression", compression).parquet(f"{staging}/data")
    counts = df.sparkSession.read.schema(rows.schema).parquet(f"{staging}/data").groupBy(SHARD).count().orderBy(SHARD).collect()
    manifest = {
        "version": VERSION, "format": "parquet", "layout": "rows", "fingerprint": features.fingerprint(df.schema), "num_rows": sum(r["count"] for r in counts), "num_shards": len(counts),
        "shard_row_counts": [r["count"] for r in counts], "shard_names": [f"{SHARD}={r[SHARD]}" for r in counts], "compression": compression, "lineage": lineage or {}, "schema": rows.schema.jsonValue(),
    }
    Path(staging, MANIFEST).write_text(json.dumps(manifest))
    try:
        os.rename(staging, path)
    except OSError:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return manifest


def manifest_of(path: str) -> dict:
    """The table's manifest, checked: version, counts, and that each shard is there."""
    file = Path(path, MANIFEST)
    if not file.exists():
        raise FileNotFoundError(file)
    m = json.loads(file.read_text())
    for key in ("version", "format", "layout", "fingerprint", "num_rows", "num_shards", "shard_row_counts", "shard_names"):
        if key not in m:
            raise ValueError(f"manifest lacks {key}")
    if m["version"] != VERSION:
        raise ValueError(f"manifest version {m['version']} is not {VERSION}")
    if m["layout"] not in ("rows", "frames"):
        raise ValueError(f"unknown layout {m['layout']}")
    if len(m["shard_row_counts"]) != m["num_shards"] or sum(m["shard_row_counts"]) != m["num_rows"] or len(m["shard_names"]) != m["num_shards"]:
        raise ValueError("manifest counts disagree")
    for name in m["shard_names"]:
        if not Path(path, "data", name).exists():
            raise FileNotFoundError(name)
    return m


def open_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table with its row and shard ids; ``schema``, if given, must have the fingerprint that was written."""
    from pyspark.sql.types import StructType

    m = manifest_of(path)
    if schema is not None and features.fingerprint(schema) != m["fingerprint"]:
        raise ValueError("the table was written with other features; write it again")
    if m["layout"] == "frames":
        return spark.read.parquet(f"{path}/data")
    return spark.read.schema(StructType.fromJson(m["schema"])).parquet(f"{path}/data")


def write_frames(frames: DataFrame, videos: DataFrame, path: str, key: str = "video_id", index: str = "frame_idx", shards: int = 16) -> dict:
    """Write a frame table (video_id, frame_idx, payload columns) and one row a video under ``path`` with layout 'frames'.

    The video table gets ``n_frames`` and ``start_row``, the video's first row in the order of videos and frames. A video's frames lie
    together, in order; a video is in one of ``shards`` files, by hash.
    """
    from loomset.sources.sinks import frame_manifest

    if Path(path).exists():
        raise FileExistsError(path)
    staging = f"{path}.{uuid.uuid4().hex}.tmp"
    frames.withColumn(SHARD, F.pmod(F.xxhash64(key), F.lit(shards)).cast("long")).repartition(SHARD).sortWithinPartitions(key, index).write.partitionBy(SHARD).parquet(f"{staging}/data")
    spans = frame_manifest(frames.select(F.col(key).alias("video_id"))).withColumnRenamed("video_id", key)
    videos.join(spans, key, "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0))).write.parquet(f"{staging}/videos")
    stored = frames.sparkSession.read.parquet(f"{staging}/data")
    counts = stored.groupBy(SHARD).count().orderBy(SHARD).collect()
    manifest = {
        "version": VERSION, "format": "parquet", "layout": "frames", "fingerprint": features.fingerprint(frames.schema), "num_rows": sum(r["count"] for r in counts), "num_shards": len(counts), "key": key, "index": index,
        "shard_row_counts": [r["count"] for r in counts], "shard_names": [f"{SHARD}={r[SHARD]}" for r in counts], "schema": stored.schema.jsonValue(),
    }
    Path(staging, MANIFEST).write_text(json.dumps(manifest))
    os.rename(staging, path)
    return manifest


def open_windows(spark: SparkSession, path: str, length: int = 1, skip: int = 0, hop: int = 1, least: int | None = None) -> DataFrame:
    """A frame table as windows: the video's columns, video_idx, start_frame, frame_indices, frames and sample_idx, dense over all windows.

    Windows are planned from the video table alone; frames are only read for the windows that are asked for.
    """
    from loomset.operators import frames as windows
    from loomset.operators.relational import running_base

    m = manifest_of(path)
    if m["layout"] != "frames":
        raise ValueError(f"the table at {path} has layout {m['layout']}, not frames")
    key, index = m["key"], m["index"]
    videos, stored = spark.read.parquet(f"{path}/videos"), spark.read.parquet(f"{path}/data").drop(SHARD)
    planned = windows.plan_windows(videos.select(key, F.col("n_frames").cast("int").alias("n")), key, length, skip, hop, least)
    counts = running_base(planned.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key, "__n", "__first").select(key, "__first")
    planned = planned.join(counts, key).withColumn("sample_idx", F.col("__first") + F.floor(F.col("start") / hop)).drop("__first")
    value = F.struct(*[c for c in stored.columns if c not in (key, index)])
    payload = windows.window_payload(planned.select(key, "start"), stored, key, index, value, length, skip)
    rows = planned.join(payload, [key, "start"]).join(videos, key)
    at = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.col("start") + j * (skip + 1))
    return rows.select(*videos.columns, F.col("start").alias("start_frame"), at.alias("frame_indices"), F.col("payload").alias("frames"), "sample_idx")

"""Sinks with a contract: checked appends, content-addressed assets, frame tables, report tables."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.operators.relational import running_base
from loomset.sources.fetch import locked


def append_checked(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append to a table whose columns must have the same names and types in the same order.

    On a mounted path appends wait for each other, so none is checked against a table that another is making.
    """
    if "://" not in path:
        with locked(path.rstrip("/")):
            return _append(df, path, fmt)
    return _append(df, path, fmt)


def _append(df: DataFrame, path: str, fmt: str) -> None:
    spark = df.sparkSession
    try:
        have = spark.read.format(fmt).option("header", "true").load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    if have is not None:
        mine = [(f.name, None if fmt == "csv" else f.dataType.simpleString()) for f in df.schema.fields]
        other = [(f.name, None if fmt == "csv" else f.dataType.simpleString()) for f in have.schema.fields]
        if mine != other:
            raise ValueError(f"the table at {path} has columns {other}, not {mine}")
    df.write.mode("append").format(fmt).option("header", "true").save(path)


def stage_asset(path: str, folder: str) -> str:
    """Put a file into ``folder`` under the digest of its content, by link where that works; equal files are kept once."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    target = os.path.join(folder, digest.hexdigest() + os.path.splitext(path)[1].lower())
    if not os.path.exists(target):
        os.makedirs(folder, exist_ok=True)
        try:
            os.link(path, target)
        except OSError:
            shutil.copyfile(path, f"{target}.tmp")
            os.replace(f"{target}.tmp", target)
    return target


def frame_table(videos: DataFrame, decode: Callable[[bytes], list[bytes]], key: str = "video_id", content: str = "content", skip_broken: bool = False) -> DataFrame:
    """Rows (video_id, frame_idx, bytes): every video exploded by ``decode``, which gives the encoded frames of one.

    A video that can't be decoded fails the query, or with ``skip_broken`` has no rows.
    """

    def run(batches):
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    frames = decode(data)
                except Exception:
                    if not skip_broken:
                        raise
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(frames), pa.int32()), pa.array(range(len(frames)), pa.int32()), pa.array(frames, pa.binary())], ["video_id", "frame_idx", "bytes"])

    return videos.select(F.col(key).cast("int"), content).mapInArrow(run, "video_id int, frame_idx int, bytes binary")


def frame_manifest(frames: DataFrame) -> DataFrame:
    """Rows (video_id, n_frames, start_row): the first row of each video in the frame table's order, a row a video."""
    n = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return running_base(n, "video_id", "n_frames", "start_row")


def _few(df: DataFrame, limit: int) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows; aggregate, or raise the limit")
    return rows


def latex(df: DataFrame, caption: str = "", limit: int = 1000) -> str:
    """A small result as a LaTeX table; more than ``limit`` rows are an error."""
    names = df.columns
    escape = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = "\n".join(" & ".join(escape(r[n]) for n in names) + r" \\" for r in _few(df, limit))
    return "\\begin{table}\n\\caption{%s}\n\\begin{tabular}{%s}\n%s \\\\ \\hline\n%s\n\\end{tabular}\n\\end{table}" % (caption, "l" * len(names), " & ".join(map(escape, names)), body)


def csv_report(df: DataFrame, path: str, limit: int = 100_000) -> int:
    """A small result as one CSV file with a header, written at once; returns its rows. More than ``limit`` rows are an error."""
    import csv

    rows = _few(df, limit)
    with open(f"{path}.tmp", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(["" if v is None else v for v in r] for r in rows)
    os.replace(f"{path}.tmp", path)
    return len(rows)

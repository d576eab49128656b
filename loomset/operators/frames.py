"""Sliding windows over ordered rows of a group, and index sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan_windows(lengths: DataFrame, group: str, length: int = 1, skip: int = 0, hop: int = 1, least: int | None = None, size: str = "n") -> DataFrame:
    """Rows (group, start): window starts 0, hop, ... of each group of ``size`` ordered rows.

    A window spans (length - 1) * (skip + 1) + 1 rows; groups shorter than that, or than ``least``, have none.
    """
    if length < 1 or skip < 0 or hop < 1:
        raise ValueError("window length and hop must be positive, skip must not be negative")
    span = (length - 1) * (skip + 1) + 1
    enough = lengths.where(F.col(size) >= max(span, least or 1))
    return enough.select(group, F.explode(F.sequence(F.lit(0), (F.col(size) - span).cast("int"), F.lit(hop))).alias("start"))


def window_payload(windows: DataFrame, frames: DataFrame, group: str, index: str, value: Column, length: int, skip: int = 0) -> DataFrame:
    """Rows (group, start, payload): the values of each window's rows in order. The range lookup is an equi join on exploded indices."""
    wanted = windows.select(group, "start", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.col("start") + j * (skip + 1))).alias("j", "at"))
    rows = wanted.join(frames.select(group, F.col(index).alias("at"), value.alias("__v")), [group, "at"])
    return rows.groupBy(group, "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "__v"))), lambda s: s["__v"]).alias("payload"))


def sample_indices(size: Column, n: int, mode: str = "uniform", stride: int = 1, pad: str = "error", seed: int = 0, row: Column | None = None) -> Column:
    """Array of ``n`` indices below ``size``: spread evenly, from the start, around the centre, or from a hashed start.

    Too few rows: ``error`` gives null, ``repeat_last`` repeats the last index, ``loop`` begins again.
    """
    if mode == "uniform":
        step = (size - 1) / F.lit(max(1, n - 1))
        return F.when((size >= n) | F.lit(pad != "error"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * step).cast("int")))
    span = (n - 1) * stride + 1
    room = F.greatest(F.lit(0), size - span)
    starts = {"start": F.lit(0), "center": F.floor(room / 2), "random": F.pmod(F.xxhash64(F.lit(seed), row if row is not None else F.lit(0)), room + 1)}
    if mode not in starts:
        raise ValueError(f"unknown sampling mode {mode}")
    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: starts[mode].cast("int") + i * stride)
    if pad == "repeat_last":
        return F.transform(raw, lambda i: F.least(i, size - 1).cast("int"))
    if pad == "loop":
        return F.transform(raw, lambda i: (i % size).cast("int"))
    if pad == "error":
        return F.when(size >= span, raw)
    raise ValueError(f"unknown padding {pad}")


def padded(array: Column, length: int, fill: object) -> Column:
    """The array cut or filled up to ``length``."""
    return F.slice(F.concat(array, F.array_repeat(F.lit(fill), length)), 1, length)

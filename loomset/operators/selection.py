"""Positions, views and samples: everything positional is a column of dense row numbers that survives any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.session import checkpointed

POS = "__pos"
#: Rows of one range of digests, about.
RANGE = 20_000


def with_positions(df: DataFrame, *order: str | Column, name: str = POS) -> DataFrame:
    """``df`` with dense positions from 0 in the given total order.

    Rows are range-partitioned and sorted once; positions are the rank within a range plus the sizes of the ranges before, so no
    task holds the whole table. Without ``order`` rows are numbered in the order of their partitions.
    """
    part, at = "__part", "__at"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows = checkpointed(rows.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__first"))
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(part, "__first", ahead.alias("__base"))  # a row a partition
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(at) - F.col("__first") + F.col("__base")).drop(part, at, "__first", "__base")


def shuffle_key(seed: int | str, row_id: str | Column) -> Column:
    """Sort key of a seeded permutation: the same in every engine that has md5."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def shuffled(df: DataFrame, seed: int | str, row_id: str, name: str = POS) -> DataFrame:
    """Positions of a seeded permutation; ties of the hash go by the row id."""
    return by_hash(df.withColumn("__key", shuffle_key(seed, row_id)), "__key", row_id, name=name).drop("__key")


def by_hash(df: DataFrame, key: str, *ties: str | Column, name: str = POS) -> DataFrame:
    """Dense positions in the order of the hex digest ``key`` and then ``ties``, lazily.

    Digests are spread evenly, so their first digits are ranges of like size: these are counted, and rows are numbered within
    their range. Only the counts are computed at once; the rows shuffle once, when they are asked for.
    """
    n = df.count()
    digits = min(5, max(1, math.ceil(math.log(max(n, 2) / RANGE, 16))))
    rows = df.withColumn("__range", F.substring(key, 1, digits))
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    base = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", base.alias("__base"))  # 16 ** 5 rows at most
    at = F.row_number().over(Window.partitionBy("__range").orderBy(key, *ties))
    return rows.withColumn("__at", at).join(F.broadcast(starts), "__range").withColumn(name, F.col("__at") - 1 + F.col("__base")).drop("__at", "__range", "__base")


def at_indices(df: DataFrame, indices: list[int], pos: str = POS, slot: str = "slot") -> DataFrame:
    """Rows at the given positions, in their order and with duplicates; ``slot`` is the place in the list.

    The list comes from the driver, so it is bounded and broadcast. Negative indices are the caller's to resolve.
    """
    wanted = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, indices)).cast("array<bigint>")).alias(slot, pos)) if indices else df.sparkSession.createDataFrame([], f"{slot} bigint, {pos} bigint")
    return df.where(F.col(pos).isin(sorted(set(indices)))).join(F.broadcast(wanted.withColumn(slot, F.col(slot).cast("bigint"))), pos)


def sliced(df: DataFrame, start: int, stop: int, step: int = 1, pos: str = POS, slot: str = "slot") -> DataFrame:
    """Rows of ``range(start, stop, step)`` with their place in it; a range filter that reaches the scan, no join."""
    if step == 0:
        raise ValueError("slice step cannot be zero")
    inside = F.col(pos).between(start, stop - 1) if step > 0 else F.col(pos).between(stop + 1, start)
    away = (F.col(pos) - start) if step > 0 else (F.lit(start) - F.col(pos))
    return df.where(inside & (away % abs(step) == 0)).withColumn(slot, F.floor(away / abs(step)).cast("long"))


def split_at(df: DataFrame, n: int, test_size: float, pos: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a permutation of ``n`` rows, cut at floor(n * (1 - test_size))."""
    cut = int(n * (1 - test_size))
    return df.where(F.col(pos) < cut), df.where(F.col(pos) >= cut)


def sample_exact(df: DataFrame, size: int, seed: int | str, row_id: str) -> DataFrame:
    """Exactly ``size`` rows without replacement (all, if there are fewer): the least hashes, a top-k without a full sort."""
    return df.withColumn("__key", shuffle_key(seed, row_id)).orderBy("__key", row_id).limit(size).drop("__key")


def contiguous(indices: list[int]) -> tuple[int, int] | None:
    """(start, stop) when the indices are an ascending run, so that they can be a range filter."""
    if indices and all(b - a == 1 for a, b in zip(indices, indices[1:], strict=False)):
        return indices[0], indices[-1] + 1
    return None

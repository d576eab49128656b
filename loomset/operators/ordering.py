"""Epoch orders and the division of rows among workers, as columns and sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.operators.selection import by_hash, shuffle_key, shuffled, with_positions


def worker_seed(seed: int, epoch: int = 0, worker: int = 0) -> int:
    return seed + epoch * 1000 + worker


def epoch_order(seed: int, epoch: int, shard: str, row: str, within: str = "random") -> list[Column]:
    """Sort key of an epoch: all rows of a shard before the next, shards and (with ``random``) rows by hash."""
    if within not in ("random", "sequential"):
        raise ValueError(f"unknown order {within}")
    salt = seed ^ epoch
    rows = [shuffle_key(salt, row), F.col(row)] if within == "random" else [F.col(row)]
    return [shuffle_key(salt, shard), F.col(shard), *rows]


def epoch_positions(df: DataFrame, seed: int, epoch: int, shard: str, row: str, name: str, within: str = "random") -> DataFrame:
    """Dense positions of an epoch, lazily: ranges of shards' digests are counted, and rows are numbered in them."""
    first, *rest = epoch_order(seed, epoch, shard, row, within)
    return by_hash(df.withColumn("__shard_key", first), "__shard_key", *rest, name=name).drop("__shard_key")


def buffer_order(seed: int, row: str, size: int = 10_000) -> list[Column]:
    """Sort key of a bounded shuffle: rows stay within their block of ``size``."""
    return [F.floor(F.col(row) / size), shuffle_key(seed, row), F.col(row)]


def for_worker(df: DataFrame, worker: int, workers: int, shard: str, row: str, shards: int) -> DataFrame:
    """A worker's share: whole shards if there are enough of them, else every ``workers``-th row."""
    if not 0 <= worker < workers:
        raise ValueError("worker is out of range")
    return df.where(F.col(shard if shards >= workers else row) % workers == worker)


def batches(df: DataFrame, size: int, order: list[Column]):
    """Rows in order, in lists of ``size``; one partition at a time comes to the driver."""
    some: list = []
    for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
        some.append(row)
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some


KINDS = ("sequential", "random", "shard_shuffle", "buffer")


class Sampler:
    """Places of positions in an epoch's order, as a column.

    'sequential' keeps the order, 'random' permutes all rows, 'shard_shuffle' permutes shards of ``shard_rows`` and the rows in
    them (``within``), 'buffer' permutes rows within blocks of ``buffer``. The permutation depends on seed and epoch alone, so
    workers agree on it; with several workers each takes whole shards if there are enough, else every n-th row.
    """

    def __init__(self, kind: str = "shard_shuffle", seed: int = 42, shard_rows: int = 10_000, within: str = "random", buffer: int = 10_000):
        if kind not in KINDS:
            raise ValueError(f"unknown sampler {kind}")
        self.kind, self.seed, self.shard_rows, self.within, self.buffer = kind, seed, shard_rows, within, buffer

    def positions(self, df: DataFrame, row: str, epoch: int = 0, worker: int = 0, workers: int = 1, n: int | None = None) -> DataFrame:
        """``df``, or the worker's part of it, with its place in a column ``order``."""
        df = df.withColumn("__shard", F.floor(F.col(row) / self.shard_rows))
        if workers > 1:
            n = df.count() if n is None else n
            df = for_worker(df, worker, workers, "__shard", row, -(-n // self.shard_rows))
        salt = worker_seed(self.seed, epoch)
        if self.kind == "sequential":
            out = with_positions(df, row, name="order")
        elif self.kind == "random":
            out = shuffled(df, salt, row, name="order")
        elif self.kind == "buffer":
            out = with_positions(df, *buffer_order(salt, row, self.buffer), name="order")
        else:
            out = epoch_positions(df, salt, 0, "__shard", row, "order", self.within)
        return out.drop("__shard")

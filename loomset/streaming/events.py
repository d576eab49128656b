"""Event streams: windows with watermarks, deduplication, running counts kept as state. Beyond the reference, which has none."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", value: str = "value", by: str = "event_type") -> DataFrame:
    """Counts and sums by window and type; events later than ``late`` are dropped and their windows' state with them."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "12 hours", ts: str = "ts", key: str = "user_id") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def support_queue(rows: DataFrame, size: int, key: str = "label", value: str = "vec_id") -> DataFrame:
    """Rows (key, n, held): for each key the last ``size`` values, first in first out, kept as state between triggers."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = state.get if state.exists else (0, [])
        for p in parts:
            values = sorted(p[value].tolist())
            n, held = n + len(values), (held + values)[-size:]
        state.update((n, held))
        yield pd.DataFrame({key: [k[0]], "n": [n], "held": [held]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n bigint, held array<bigint>", "n bigint, held array<bigint>", "update", GroupStateTimeout.NoTimeout)

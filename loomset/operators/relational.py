"""Joins with defaults and audits, pivots, ranks and histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_default(left: DataFrame, right: DataFrame, on: str | list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join; the right side's columns named in ``defaults`` take that value where nothing matches or they are null."""
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def anti_audit(left: DataFrame, right: DataFrame, key: str, show: int = 5) -> DataFrame:
    """One row: how many keys of ``left`` have no match, and the least few of them, comma-separated."""
    missing = left.select(key).join(right.select(key), key, "left_anti")
    few = missing.orderBy(key).limit(show).agg(F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("first_ids"))
    return missing.agg(F.count(F.lit(1)).alias("n_missing")).crossJoin(few)


def join_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails, with an example, if a key of ``left`` has no match."""
    joined = left.join(right.withColumn("__there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no match for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.where(F.when(F.col("__there").isNull(), missing.cast("boolean")).otherwise(True)).drop("__there")


def replaced(df: DataFrame, mask: Column, rows: DataFrame) -> DataFrame:
    """``df`` with the rows that ``mask`` holds for replaced by ``rows``, which have the same columns; a null mask keeps the row."""
    return df.where(~F.coalesce(mask, F.lit(False))).unionByName(rows)


def overlaid(defaults: DataFrame, overrides: DataFrame, keys: list[str], by: str, value: str) -> DataFrame:
    """Every key of ``overrides`` with every setting of ``defaults``, its own value where it has one.

    ``defaults`` is a row a setting (``by``, ``value``), a configuration's size; settings that only an override has stay too.
    """
    wanted = overrides.select(*keys).distinct().crossJoin(F.broadcast(defaults.select(by, F.col(value).alias("__d"))))
    return wanted.join(overrides.select(*keys, by, value), [*keys, by], "full").select(*keys, by, F.coalesce(value, "__d").alias(value))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def normalised(value: Column, chance: Column, ceiling: Column) -> Column:
    """(value - chance) / (ceiling - chance) where the ceiling is above chance, else null."""
    return F.when(ceiling - chance > 0, (value - chance) / (ceiling - chance))


def dense_codes(df: DataFrame, column: str, into: str) -> DataFrame:
    """Number of each value among the sorted distinct values, from 0; the distinct values are numbered, not the rows."""
    from loomset.operators.selection import with_positions

    codes = with_positions(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name=into)
    return df.join(codes, column, "left")


#: Ranges that a column's values are cut into for running totals, and rows that one block of keys has.
RANGES, KEYS = 512, 65_536


def running_base(df: DataFrame, key: str, n: str, into: str) -> DataFrame:
    """``df`` with the sum of ``n`` over all rows of lesser whole-number ``key``: totals by blocks of keys, then within a block."""
    block = df.withColumn("__b", F.floor(F.col(key) / KEYS))
    sums = block.groupBy("__b").agg(F.sum(n).alias("__s"))
    sums = sums.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    ahead = F.coalesce(F.sum(n).over(Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return block.withColumn("__a", ahead).join(sums, "__b").withColumn(into, F.col("__base") + F.col("__a")).drop("__b", "__a", "__base")


def average_ranks(df: DataFrame, column: str, into: str) -> DataFrame:
    """Ranks of a double column with ties averaged.

    Only distinct values are ranked: their counts are summed up within ranges, between bounds that approximate quantiles of
    the values give (the ranks are exact), so no task sees all of them.
    """
    from pyspark.ml.feature import Bucketizer

    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    bounds = sorted(set(df.approxQuantile(column, [i / RANGES for i in range(1, RANGES)], 0.002)))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=column, outputCol="__b").transform(counts) if bounds else counts.withColumn("__b", F.lit(0.0))
    base = cut.groupBy("__b").agg(F.sum("__c").alias("__s"))
    base = base.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    upto = F.sum("__c").over(Window.partitionBy("__b").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    # the bases are a row a range, RANGES at most
    ranked = cut.withColumn("__u", upto).join(F.broadcast(base), "__b").select(column, (F.col("__base") + F.col("__u") - (F.col("__c") - 1) / 2).alias(into))
    return df.join(ranked, column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho): infinities count as null, rows with nulls go, fewer than three rows give null."""
    ok = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ok = ok.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in "xy"))
    ranked = average_ranks(average_ranks(ok, "x", "rx"), "y", "ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho")).select("n", F.when(F.col("n") >= 3, F.col("rho")).alias("rho"))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value by the t distribution with n - 2 degrees of freedom."""
    if n < 3 or rho is None:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    return _incomplete_beta(df / 2, 0.5, df / (df + rho * rho * df / (1 - rho * rho)))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
        c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def class_balance(labels: DataFrame, column: str) -> DataFrame:
    """One row (n_classes, n_rows, balance, imbalance): entropy over its maximum, 1 for one class, and greatest over least count."""
    counts = labels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("hi"), F.min("n").alias("lo"))
    share = F.col("n") / F.col("n_rows")
    return (
        counts.crossJoin(F.broadcast(total))
        .groupBy("n_classes", "n_rows", "hi", "lo")
        .agg(F.sum(share * F.ln(share)).alias("h"))
        .select(
            "n_classes",
            "n_rows",
            F.round(F.when(F.col("n_classes") <= 1, F.lit(1.0)).otherwise(-F.col("h") / F.ln("n_classes")), 6).alias("balance"),
            F.round(F.col("hi") / F.col("lo"), 6).alias("imbalance"),
        )
    )


def block_max(column: str, bounds: list[tuple[int, int]]) -> list[Column]:
    """Maxima of the array blocks [start, stop)."""
    return [F.round(F.array_max(F.slice(column, a + 1, z - a)), 6).alias(f"block{k}") for k, (a, z) in enumerate(bounds)]

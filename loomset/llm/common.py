"""What several operators share: free column names, labelled samples, components, columns carried through Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.operators.selection import with_positions
from loomset.session import checkpointed, shuffle_partitions

#: Bytes of input for each slot of hashes, and slots at most, at which a slot of 100 TB still fits a worker.
PER_SLOT, MOST_SLOTS = 2 << 20, 1 << 16


def fresh(df: DataFrame, name: str) -> str:
    """A column name near ``name`` that ``df`` doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: safe to hand to Python whatever its names are."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def slots_of(df: DataFrame) -> int:
    """Number of slots for hashes of ``df``'s texts: it follows the size of the files read, so that a slot's hashes fit one worker.

    What has no known size, such as rows from the driver, counts by the shuffle partitions alone.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = sum(n for n in known if n < 1 << 60)
    return max(shuffle_partitions(df.sparkSession), min(MOST_SLOTS, size // PER_SLOT))


def coded(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with ``key`` as bigint, and the codes (code, key) that ``decoded`` needs; None where keys are whole numbers already.

    Other keys (text, dates, decimals) are numbered in their order, so the least key has the least code.
    """
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return df.withColumn(key, df[key].cast("bigint")), None
    code, old = fresh(df, "code"), fresh(df, "old_key")
    codes = checkpointed(with_positions(df.select(df[key].alias(old)).where(F.col(old).isNotNull()).distinct(), old, name=code))
    out = df.join(codes, df[key] == codes[old], "left").withColumn(key, F.col(code)).drop(code, old)
    return out, codes.select(F.col(code).alias("code"), F.col(old).alias("key"))


def decoded(df: DataFrame, codes: DataFrame | None, *columns: str) -> DataFrame:
    """``df`` with the codes in ``columns`` turned into keys again."""
    if codes is None:
        return df
    names = df.columns
    for c in columns:
        df = df.join(codes.select(F.col("code").alias(c), F.col("key").alias(f"__{c}")), c).drop(c).withColumnRenamed(f"__{c}", c)
    return df.select(*names)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Rows (y, x) of up to ``per_class`` labelled documents a class, the same ones whatever the partitioning.

    The sample is bounded, so broadcasting its keys is too. A document with labels of both classes counts as 0, one whose key
    repeats has its least text. Rows with a null key, label or text are left out.
    """
    one = labels.where(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("k")).agg(F.min(labels[label].cast("int")).alias("y"))
    one = one.withColumn("o", F.xxhash64("k"))
    few = one.where("y = 0").orderBy("o", "k").limit(per_class).unionByName(one.where("y <> 0").orderBy("o", "k").limit(per_class))
    found = docs.where(docs[text].isNotNull()).select(docs[key].alias("k"), docs[text].alias("x")).join(F.broadcast(few), "k")
    return found.groupBy("k").agg(F.max("y").alias("y"), F.min("x").alias("x")).select(F.when(F.col("y") != 0, 1).otherwise(0).alias("y"), "k", "x")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): rows (k, root), root being the least node; roots have no row of their own.

    Alternates large-star and small-star steps until nothing changes, with lineage cut after each round. The rounds
    grow with the logarithm of the longest chain.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    by = Window.partitionBy("u")
    e, before = checkpointed(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(by))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.withColumn("m", F.min("v").over(by))
        small = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("k"), F.col("v").alias("root"))
        before = now

"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the schedule gets the golden-ratio point ``i * phi mod 1``, in 64-bit integers; the source whose interval of
cumulative weights holds the point is served. The r-th slot of a source takes the r-th of its blocks, again
from the first when they are used up. Blocks have an equal number of tokens: a source's documents, in the order of a
salted hash, are cut at multiples of ``block_tokens``.

No step puts a source into one task: token positions come from prefix sums over hash buckets, slot ranks from prefix sums
over chunks of slots. Texts shuffle once, to meet their list of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.llm import common, textkit
from loomset.session import checkpointed, shuffle_partitions

PHI = 0x9E3779B97F4A7C15
BLOCK, ALPHA, SEED = 512, 0.9, "mix-1"
#: Slots of one chunk, and slots above the expected number that are tried first for every source to reach its last block.
CHUNK_SLOTS, SPARE = 1 << 16, 256
MAX_SOURCES = 1_000_000
#: Blocks and epochs whose pieces of one document go into one list.
LIST_BLOCKS, LIST_EPOCHS = 1024, 4


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = textkit.as_bytes(b.column(2))
        n = []
        for i, j in textkit.chunks(texts):
            buf, offsets = textkit.joined(texts[i:j])
            n.append(np.diff(np.searchsorted(textkit.word_spans(buf)[0], offsets)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], ["k", "s", "n"])


def points(first: int, n: int, total: int) -> np.ndarray:
    """floor(total * point) for slots first, ..., first + n - 1; ``total`` is below 2**23."""
    x = np.arange(first, first + n, dtype=np.uint64) * np.uint64(PHI)
    return ((x >> np.uint64(24)) * np.uint64(total) >> np.uint64(40)).astype(np.int64)


def _served(cuts: np.ndarray, ranked: bool):
    """Slots of the chunks: counts by source, or, given the counts before each chunk, the slots with their ranks."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                first = row["chunk"] * CHUNK_SLOTS
                source = np.searchsorted(cuts, points(first, CHUNK_SLOTS, int(cuts[-1])), side="right")
                if not ranked:
                    which, n = np.unique(source, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), row["chunk"])), pa.array(which.astype(np.int64)), pa.array(n.astype(np.int64))], ["chunk", "i", "n"])
                    continue
                before = {x["i"]: x["before"] for x in row["bases"]}
                order = np.argsort(source, kind="stable")
                which, at, n = np.unique(source[order], return_index=True, return_counts=True)
                rank = np.empty(CHUNK_SLOTS, np.int64)
                for i, a, m in zip(which.tolist(), at.tolist(), n.tolist(), strict=True):
                    rank[order[a : a + m]] = np.arange(before[i], before[i] + m)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + CHUNK_SLOTS)), pa.array(source.astype(np.int64)), pa.array(rank)], ["slot", "i", "r"])

    return run


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, float] | None = None, block_tokens: int = BLOCK, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """Rows (slot, source, epoch, block, doc_id, start_token, end_token): the mix, in order of slot and position.

    Weights are ``weights`` by source or, without them, the shares of tokens to the power ``alpha``; they are rounded
    to millionths, one at least. The schedule ends with the slot in which every source has served its last block, so nothing
    is left out; sources that weigh more than they hold come again, in later epochs.

    Cases: tokens are runs of other than space, tab, line feed and return; a text of any length is counted whole. The last block of a source may be
    short. A null source counts as source 'unknown'. Rows with a null key, and null or blank texts, have no tokens and
    no place. Rows that repeat a key are one document, of the most tokens, then the greatest source. Sources
    that ``weights`` doesn't name are left out. Equal hashes are ordered by key. An empty table
    gives an empty schedule. More than MAX_SOURCES sources raise ValueError, since the table of weights is on the driver.
    """
    return _planned(docs, key, text, source, weights, block_tokens, alpha, seed)[0]


def _planned(docs: DataFrame, key: str, text: str, source: str, weights: dict[str, float] | None = None, block_tokens: int = BLOCK, alpha: float = ALPHA, seed: str = SEED) -> tuple[DataFrame, int]:
    """The schedule and its last slot, -1 if there is none."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    some = docs.where(docs[key].isNotNull() & docs[text].isNotNull()).select(docs[key].alias("k"), F.coalesce(docs[source].cast("string"), F.lit("unknown")).alias("s"), docs[text].alias("x"))
    sized = some.mapInArrow(_counted, f"k {kind}, s string, n bigint").where("n > 0").groupBy("k").agg(F.max(F.struct("n", "s")).alias("m")).select("k", "m.s", "m.n")
    if weights is not None:
        sized = sized.where(F.col("s").isin(list(weights)))
    o = F.md5(F.concat(F.lit(seed + ":"), F.col("k").cast("string")))
    sized = checkpointed(sized.withColumn("o", o).withColumn("g", F.substring("o", 1, 3)))
    totals = sized.groupBy("s").agg(F.sum("n").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted((r["s"], r["t"]) for r in totals)
    shape = f"slot bigint, source string, epoch bigint, block bigint, doc_id {kind}, start_token bigint, end_token bigint"
    if not totals:
        return spark.createDataFrame([], shape), -1
    raw = [float(t) ** alpha if weights is None else float(weights[s]) for s, t in totals]
    if min(raw) <= 0:
        raise ValueError("weights must be positive")
    ppm = [max(1, int(1e6 * x / sum(raw))) for x in raw]
    cuts, blocks = np.cumsum(ppm), [-(-t // block_tokens) for _, t in totals]
    slots = max(-(-b * int(cuts[-1]) // p) for b, p in zip(blocks, ppm, strict=True)) + SPARE
    counts, have, lacking = None, [0] * len(totals), True
    first = 0
    while lacking:
        last = -(-slots // CHUNK_SLOTS)
        chunks = spark.range(first, last).select(F.col("id").alias("chunk"))
        more = checkpointed(chunks.mapInArrow(_served(cuts, False), "chunk bigint, i bigint, n bigint"))
        for r in more.groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():
            have[r["i"]] += r["n"]
        counts, first = more if counts is None else counts.unionByName(more), last
        # a light source's points come late by up to a few times 1 / weight slots
        lacking = [(b - n + 1) * int(cuts[-1]) // p for b, n, p in zip(blocks, have, ppm, strict=True) if n < b]
        slots = last * CHUNK_SLOTS + max(lacking, default=0)
    ahead = Window.partitionBy("i").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).groupBy("chunk").agg(F.collect_list(F.struct("i", "before")).alias("bases"))
    sources = spark.createDataFrame([(i, s, b) for i, ((s, _), b) in enumerate(zip(totals, blocks, strict=True))], "i bigint, s string, b bigint")
    ranked = checkpointed(bases.mapInArrow(_served(cuts, True), "slot bigint, i bigint, r bigint").join(F.broadcast(sources), "i"))
    end = ranked.where("r = b - 1").agg(F.max("slot")).first()[0]
    served = ranked.where(F.col("slot") <= end).select("slot", "s", F.floor(F.col("r") / F.col("b")).alias("epoch"), (F.col("r") % F.col("b")).alias("block"))

    groups = sized.groupBy("s", "g").agg(F.sum("n").alias("t"))
    base = groups.select("s", "g", F.coalesce(F.sum("t").over(Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.sum("n").over(Window.partitionBy("s", "g").orderBy("o", "k").rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("e", within).join(base, ["s", "g"]).select("k", "s", "n", (F.col("base") + F.col("e") - F.col("n")).alias("c"))
    size = F.lit(block_tokens)
    pieces = placed.select("k", "s", "n", "c", F.explode(F.sequence(F.floor(F.col("c") / size), F.floor((F.col("c") + F.col("n") - 1) / size))).alias("block"))
    pieces = pieces.select(
        "k", "s", "block", F.greatest(F.lit(0), F.col("block") * size - F.col("c")).cast("bigint").alias("start_token"), F.least(F.col("n"), (F.col("block") + 1) * size - F.col("c")).cast("bigint").alias("end_token")
    )
    plan = pieces.join(served, ["s", "block"]).select("slot", F.col("s").alias("source"), "epoch", "block", F.col("k").alias("doc_id"), "start_token", "end_token")
    return plan, end


def _cut(at_text: int, at_length: int, at_list: int):
    """Each row once for each of its pieces, with the piece as text; the list of pieces gives the schedule's columns."""

    def run(batches):
        for b in batches:
            texts, lists = textkit.as_bytes(b.column(at_text)), b.column(at_list)
            n = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), n)
            start, end = flat.field("start_token").to_numpy(), flat.field("end_token").to_numpy()
            pieces: list[bytes] = []
            have = np.ones(len(row), bool)
            for i, j in textkit.chunks(texts):
                buf, offsets = textkit.joined(texts[i:j])
                words = textkit.word_spans(buf)[0]
                first = np.searchsorted(words, offsets)
                lo, hi = np.searchsorted(row, [i, j])
                r = row[lo:hi] - i
                words = np.append(words, len(buf))
                have[lo:hi] = start[lo:hi] < np.diff(first)[r]
                a = words[np.minimum(first[r] + start[lo:hi], len(words) - 1)]
                z = np.minimum(words[np.minimum(first[r] + end[lo:hi], len(words) - 1)], offsets[r + 1] - 1)
                raw = buf.tobytes()
                pieces += [raw[x:y] for x, y in zip(a.tolist(), z.tolist(), strict=True)]
            new = pa.array(pieces, pa.binary()).cast(pa.string())
            at = pa.array(row)
            columns = [b.column(c).take(at) for c in range(b.num_columns) if c != at_list]
            columns[at_text] = new
            if at_length >= 0:
                columns[at_length] = pc.utf8_length(new).cast(columns[at_length].type)
            columns += [flat.field(f) for f in ("slot", "epoch", "block", "start_token", "end_token")]
            out = pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
            yield out if have.all() else out.filter(pa.array(have))

    return run


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars", with_schedule: bool = False, in_order: bool = False, **options) -> DataFrame:
    """The mix of ``schedule`` with its texts: a row for each piece, with all columns of the document.

    A piece starts at its first token and ends before the next piece's, so pieces put together give the text (without white
    space before the first token). ``length``, if there is one, becomes the piece's. ``with_schedule`` adds the columns
    slot, epoch, block, start_token, end_token; with ``in_order`` the rows are in the order of slots, partition after partition, so
    that files written from them hold the mix. Rows that repeat a key each give the pieces of that key that
    their text has tokens for. A document of many blocks and epochs meets several lists of pieces, each of a bounded length.
    """
    plan, end = _planned(docs, key, text, source, **options)
    lists = plan.groupBy("doc_id", F.floor(F.col("block") / LIST_BLOCKS), F.floor(F.col("epoch") / LIST_EPOCHS)).agg(F.collect_list(F.struct("slot", "epoch", "block", "start_token", "end_token")).alias("__pieces"))
    joined = docs.join(lists.select(F.col("doc_id").alias(key2 := common.fresh(docs, "mixed")), F.col("__pieces").alias(pieces := common.fresh(docs, "pieces"))), docs[key] == F.col(key2))
    joined = joined.select(*[docs[c] for c in docs.columns], F.col(pieces))
    fields = docs.schema.fields
    names = [f.name for f in fields]
    shape = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate([*(f.dataType for f in fields), *[T.LongType()] * 5])])
    out = common.positional(joined).mapInArrow(_cut(names.index(text), names.index(length) if length in names else -1, len(names)), shape)
    extra = ["slot", "epoch", "block", "start_token", "end_token"]
    if in_order:
        n, slot, start = shuffle_partitions(docs.sparkSession), F.col(f"c{len(names)}"), F.col(f"c{len(names) + 3}")
        at = F.col(f"c{names.index(key)}")
        out = out.repartitionById(n, F.floor(slot * n / (end + 1)).cast("int")).sortWithinPartitions(slot, F.md5(F.concat(F.lit(":"), at.cast("string"))), at, start)
    if with_schedule:
        return out.toDF(*names, *extra)
    return out.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id AS k, coalesce(source, 'unknown') AS s, text, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n, md5('{SEED}:' || doc_id) AS o
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY s ORDER BY o, k ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS c FROM d WHERE n > 0),
t AS (SELECT s, CAST(sum(n) AS BIGINT) AS t, CAST(ceil(sum(n) / {BLOCK}) AS BIGINT) AS b FROM p GROUP BY s),
w AS (SELECT *, greatest(1, CAST(floor(1e6 * t ** {ALPHA} / (SELECT sum(t ** {ALPHA}) FROM t)) AS BIGINT)) AS ppm FROM t),
cut AS (SELECT *, CAST(sum(ppm) OVER (ORDER BY s) AS BIGINT) AS hi, CAST(sum(ppm) OVER () AS BIGINT) AS total FROM w),
i AS (SELECT unnest(range((SELECT CAST(max(ceil((b + 12) * total / ppm)) AS BIGINT) + {SPARE} FROM cut))) AS slot),
x AS (SELECT slot, ((slot::HUGEINT * {PHI}::HUGEINT) % {1 << 64}::HUGEINT // {1 << 24}) * (SELECT any_value(total) FROM cut) // {1 << 40}::HUGEINT AS x FROM i),
r AS (SELECT slot, s, b, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS r FROM x JOIN cut ON x >= hi - ppm AND x < hi),
v AS (SELECT slot, s, r // b AS epoch, r % b AS block FROM r WHERE slot <= (SELECT max(slot) FROM r WHERE r = b - 1)),
q AS (SELECT k, s, text, n, c, unnest(range(c // {BLOCK}, (c + n - 1) // {BLOCK} + 1)) AS block FROM p)
SELECT slot, s AS source, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, k AS doc_id,
  CAST(greatest(0, block * {BLOCK} - c) AS BIGINT) AS start_token, CAST(least(n, (block + 1) * {BLOCK} - c) AS BIGINT) AS end_token,
  array_to_string(list_slice(regexp_extract_all(text, '[^ \t\n\r]+[ \t\n\r]*'), CAST(greatest(0, block * {BLOCK} - c) AS BIGINT) + 1, CAST(least(n, (block + 1) * {BLOCK} - c) AS BIGINT)), '') AS text
FROM q JOIN v USING (s, block)
"""

"""Line dedup with two Bloom filters.

Pass 1 hashes every line in numpy and sends packed 8-byte hashes to the slot that owns their range. Each slot
keeps a Bloom filter of hashes seen once and one of hashes seen again; only the second leaves the slot. Pass 2
probes it: lines that cannot repeat stay where they are, and only suspected repeats shuffle, with their text,
for the exact comparison and the choice of the first occurrence. A false positive costs a shuffle of one line
and never changes the result. Documents that lose no line are told by a filter of keys and don't shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import common, textkit
from loomset.llm.slots import filter_of, key_filter, key_hash, may_have, opened, packed, suspects_of, unpacked
from loomset.session import checkpointed

#: A filter is broadcast up to this many bytes; beyond, suspects and changed texts are found by a shuffled join.
BROADCAST_LIMIT = 128 << 20
#: Lines, at most, that are hot; least occurrences and greatest length of such a line.
HOT, HOT_LEAST, HOT_LENGTH = 10_000, 10_000, 1_000


def line_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the lines of a chunk that are not blank: hash, text index, line number, start and end in the joined buffer."""
    buf, offsets = textkit.joined(texts)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = np.searchsorted(starts, offsets[:-1])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    number = np.arange(len(starts)) - first[doc]
    ink = np.concatenate([[0], np.cumsum(~textkit.SPACE[buf])])
    keep = ink[ends] > ink[starts]
    starts, ends = starts[keep], ends[keep]
    return textkit.span_hashes(buf, starts, ends), doc[keep], number[keep], starts, ends


def _packed(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes():
            for b in batches:
                texts = textkit.as_bytes(b.column(0))
                for i, j in textkit.chunks(texts):
                    yield {"hashes": line_hashes(texts[i:j])[0]}

        yield from packed(hashes(), slots)

    return run


def _owned(table: pa.Table) -> pa.Table:
    (h,) = unpacked(table, hashes=np.uint64)
    suspects = suspects_of(h)
    keep = len(suspects) > 0
    return pa.table(
        {
            "slot": pa.array([table["slot"][0].as_py()] if keep else [], pa.int32()),
            "twice": pa.array([filter_of(suspects).tobytes()] if keep else [], pa.binary()),
            "suspects": pa.array([suspects.astype(np.int64).tolist()] if keep else [], pa.list_(pa.int64())),
        }
    )


def _lines(batches: Iterator[pa.RecordBatch], kept) -> Iterator[pa.RecordBatch]:
    """Rows (doc, line number, hash, text) of the lines that ``kept`` accepts by hash."""
    for b in batches:
        texts, keys = textkit.as_bytes(b.column(1)), b.column(0)
        for i, j in textkit.chunks(texts):
            h, doc, number, starts, ends = line_hashes(texts[i:j])
            at = np.flatnonzero(kept(h))
            buf = b"\n".join(texts[i:j])
            lines = [buf[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(doc[at] + i)), pa.array(number[at].astype(np.int32)), pa.array(h[at].astype(np.int64)), pa.array(lines, pa.binary()).cast(pa.string())],
                ["k", "n", "h", "line"],
            )


def _probing(filters, slots: int):
    def run(batches):
        yield from _lines(batches, opened(filters, slots).has)

    return run


def _all_lines(batches):
    yield from _lines(batches, lambda h: np.ones(len(h), bool))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs`` with each line kept only where it first occurs, by ``key`` and then by position.

    All columns stay; ``length``, if there is one, becomes the length of the text that is left.

    Cases: lines are compared exactly, after splitting at line feeds. Blank lines (only spaces, tabs, returns) are
    always kept. A text that loses all lines becomes empty; its row stays. A null or empty text stays as it
    is. Rows with a null key stay as they are and count as no occurrence. Rows that repeat a key
    share its decisions. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    slots = common.slots_of(docs)
    kind = docs.schema[key].dataType.simpleString()
    some = docs.where(docs[key].isNotNull() & (F.length(docs[text]) > 0)).select(docs[key].alias("k"), docs[text].alias("x"))
    owned = checkpointed(some.select("x").mapInArrow(_packed(slots), "slot int, hashes binary").groupBy("slot").applyInArrow(_owned, "slot int, twice binary, suspects array<bigint>"))
    size = owned.agg(F.coalesce(F.sum(F.length("twice")), F.lit(0)).alias("n")).first()["n"]
    shape = f"k {kind}, n int, h bigint, line string"
    if size <= broadcast_limit:
        filters = spark.sparkContext.broadcast({r["slot"]: bytes(r["twice"]) for r in owned.select("slot", "twice").toLocalIterator()})
        suspected = some.mapInArrow(_probing(filters, slots), shape)
    else:
        suspected = some.mapInArrow(_all_lines, shape).join(owned.select(F.explode("suspects").alias("h")), "h", "left_semi")
    suspected = suspected.select("k", "n", "line")
    first = suspected.groupBy("line").agg(F.min(F.struct("k", "n")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = checkpointed(first.select("line", "f", "c"))
    k, drop, new, lines = (common.fresh(docs, c) for c in ("drop_key", "drop_lines", "new_text", "lines"))
    # the lines with the most occurrences, HOT at most, meet them where they are; the others' occurrences shuffle
    total = first.agg(F.sum("c")).first()[0] or 0
    is_hot = (F.col("c") > max(HOT_LEAST, total // HOT)) & (F.length("line") <= HOT_LENGTH)
    hot = F.broadcast(first.where(is_hot).select("line", F.col("f").alias("hf")))
    some_lines = suspected.join(hot, "line", "left").select("k", "n", "hf", F.when(F.col("hf").isNull(), F.col("line")).otherwise(F.concat(F.lit("\n"), F.col("k").cast("string"))).alias("line"))
    decided = some_lines.join(first.where(~is_hot).select("line", "f"), "line", "left").withColumn("f", F.coalesce("hf", "f"))
    drops = checkpointed(decided.where("f is not null and (k != f.k or n != f.n)").groupBy(F.col("k").alias(k)).agg(F.collect_set("n").alias(drop)))
    changed, same = docs, None
    # texts that lose no line stay where they are
    if (affected := key_filter(drops.select(k), slots, broadcast_limit)) is not None:
        hit = may_have(affected, slots)(key_hash(docs[key]))
        changed, same = docs.where(hit), docs.where(~hit)
    # explode makes the lines a column, which else would be split again for every line that is kept
    out = changed.join(drops, changed[key] == F.col(k), "left").withColumn(lines, F.explode(F.array(F.split(changed[text], "\n", -1))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    out = out.withColumn(new, F.when(F.col(drop).isNull(), changed[text]).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n")))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(new).alias(c))
        elif c == length:
            columns.append(F.when(F.col(drop).isNull(), changed[c]).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(changed[c])
    out = out.select(*columns)
    return out if same is None else out.unionAll(same)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS o, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM r WHERE o = 1 OR blank GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, d.lang, d.source,
  CAST(length(CASE WHEN d.text IS NULL OR d.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END) AS BIGINT) AS n_chars
FROM documents d LEFT JOIN k USING (doc_id)
"""

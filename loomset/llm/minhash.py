"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text's word 3-grams are hashed once; the k least values are its sketch. Exact copies collapse first.
2. Retained values that two texts share form inverted lists. A pair whose estimated Jaccard reaches the
   bound shares a value among the rarest of each sketch (prefix filter), so only those are posted: values that many
   unrelated texts share are not.
3. Each list links its members to one member, chosen by hash; the links' overlap in the union sketch estimates the
   Jaccard index, and the exact index over all n-grams decides. Most members of a group join it here, in
   linear work.
4. Members of one list that are still in different components are then compared too, so that no link is left out. Short
   lists give their pairs; long ones are cut into blocks, whose tasks compare sketches and give only pairs that may be near.
   Components of the links are the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import common, textkit
from loomset.llm.slots import key_filter, key_hash, may_have, packed, unpacked
from loomset.session import checkpointed

#: Sketch size, words of a shingle, Jaccard index from which two texts are near duplicates.
K, WORDS, JACCARD = 64, 3, 0.5
#: The estimate may fall this many standard errors short of JACCARD.
SLACK = 3.0
#: A filter of the documents to verify is broadcast up to this many bytes; beyond, all documents' shingles shuffle.
BROADCAST_LIMIT = 128 << 20
#: Members of a list that gives its pairs as they are; members of a block of a longer list.
SHORT, BLOCK = 256, 2048


def shingles(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each folded text. A text of fewer words has one; without words, none."""
    h, doc, _ = textkit.words(texts)
    g, doc = textkit.ngrams(h, doc, n)
    g = g.astype(np.int64)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[keep], doc[keep]
    return np.split(g, np.searchsorted(doc, np.arange(1, len(texts))))


def estimate(jaccard: float, k: int) -> float:
    """The least estimate that lets a pair through to the exact test."""
    return jaccard - SLACK * math.sqrt(jaccard * (1 - jaccard) / k)


def _sketched(k: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in raw]
            texts = [textkit.folded(t) for t in raw]
            found = [s[:k] for i, j in textkit.chunks(texts) for s in shingles(texts[i:j], words)]
            at = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(at), values)], ["k", "d", "s"])

    return run


def _valued(slots: int):
    """Sketch values and their documents, packed by the slot that owns the value."""

    def run(batches):
        def values():
            for b in batches:
                s = b.column(1)
                v, n = s.flatten().to_numpy(), np.diff(s.offsets.to_numpy())
                yield {"v": v, "k": np.repeat(b.column(0).to_numpy(), n), "n": np.repeat(n, n).astype(np.int32)}

        yield from packed(values(), slots, lambda c: textkit.mix(c["v"].astype(np.uint64)))

    return run


def _shared(t: pa.Table) -> pa.Table:
    """Of a slot, the values that two documents or more retain, with the number of documents."""
    v, k, n = unpacked(t, v=np.int64, k=np.int64, n=np.int32)
    _, at, counts = np.unique(v, return_inverse=True, return_counts=True)
    df = counts[at]
    keep = df > 1
    return pa.table({"k": k[keep], "n": n[keep], "v": v[keep], "df": df[keep].astype(np.int64)})


def _sets(words: int):
    """Shingle sets of documents, with the digest of the text."""

    def run(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            texts = [textkit.folded(t) for t in raw]
            for i, j in textkit.chunks(texts):
                digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in raw[i:j]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in shingles(texts[i:j], words)], pa.binary())], ["k", "d", "g"])

    return run


def _exact(jaccard: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= jaccard * (len(p) + len(q) - both) and both > 0)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    return run


def _across(t: pa.Table) -> pa.Table:
    """All pairs of a list whose members are in different components."""
    k, c = t["k"].to_numpy(), t["c"].to_numpy()
    order = np.argsort(c, kind="stable")
    k, c = k[order], c[order]
    end = np.searchsorted(c, c, side="right")
    n = len(k) - end
    left = np.repeat(np.arange(len(k)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(end, n)
    a, b = k[left], k[right]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of values that each sketch of ``a`` shares with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.int16)
    v, w = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    i, j = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    p, q = np.argsort(v, kind="stable"), np.argsort(w, kind="stable")
    v, i, w, j = v[p], i[p], w[q], j[q]
    values, start, n = np.unique(v, return_index=True, return_counts=True)
    lo, hi = np.searchsorted(w, values, "left"), np.searchsorted(w, values, "right")
    both = n * (hi - lo)
    few = np.flatnonzero((both > 0) & (both <= 64))
    # pairs of rare values at once: the c-th pair of a value is its (c // m)-th and (c % m)-th occurrences
    size, m = both[few], (hi - lo)[few]
    c = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    m, s0, l0 = (np.repeat(x, size) for x in (m, start[few], lo[few]))
    np.add.at(out, (i[s0 + c // np.maximum(m, 1)], j[l0 + c % np.maximum(m, 1)]), 1)
    for x in np.flatnonzero(both > 64).tolist():
        out[np.ix_(i[start[x] : start[x] + n[x]], j[lo[x] : hi[x]])] += 1
    return out


def _blocks(k: int, bound: float):
    """Of two blocks of a list (or one with itself), the pairs in different components whose sketches overlap enough."""

    def run(t: pa.Table) -> pa.Table:
        keys, c, s = t["k"].to_numpy(), t["c"].to_numpy(), [np.array(x, np.int64) for x in t["s"].to_pylist()]
        left, right = np.flatnonzero(t["b"].to_numpy() == t["x"].to_numpy()), np.flatnonzero(t["b"].to_numpy() == t["y"].to_numpy())
        both = overlaps([s[i] for i in left], [s[j] for j in right])
        size = np.array([len(x) for x in s], np.int32)
        union = np.minimum(k, size[left][:, None] + size[right][None] - both)
        i, j = np.nonzero((both >= bound * union) & (both > 0) & (c[left][:, None] != c[right][None]))
        a, b = keys[left][i], keys[right][j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        _, once = np.unique(np.stack([a, b]), axis=1, return_index=True)
        return pa.table({"a": a[once], "b": b[once]})

    return run


def near_pairs(docs: DataFrame, slots: int, jaccard: float = JACCARD, k: int = K, words: int = WORDS, broadcast_limit: int = BROADCAST_LIMIT, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """Links (a, b), a < b, of documents (k, x), whose components are the groups of near duplicates; exact copies are linked to the least key."""
    bound = estimate(jaccard, k)
    some = docs.where(F.col("k").isNotNull() & F.col("x").isNotNull())
    sketches = checkpointed(some.mapInArrow(_sketched(k, words), "k bigint, d binary, s array<bigint>"))
    one = sketches.groupBy("k").agg(F.min("d").alias("d"))
    reps = one.groupBy("d").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("c"))
    copies = one.select("d", F.col("k").alias("b")).join(reps.where("c > 1").select("d", F.col("k").alias("a")), "d").where("a < b").select("a", "b")
    unique = checkpointed(sketches.join(reps.select("d", "k"), ["d", "k"], "left_semi").dropDuplicates(["k"]))

    shared = unique.where(F.size("s") > 0).select("k", "s").mapInArrow(_valued(slots), "slot int, v binary, k binary, n binary").groupBy("slot").applyInArrow(_shared, "k bigint, n int, v bigint, df bigint")
    least = F.ceil(F.col("n") * F.lit(bound)).cast("int")
    lists = (
        shared.groupBy("k", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
        .where(F.size("vs") >= F.greatest(least, F.lit(1)))
        .select("k", F.explode(F.slice("vs", F.lit(1), F.size("vs") - F.greatest(least, F.lit(1)) + 1)).alias("e"))
    )
    postings = checkpointed(lists.select("k", F.col("e.v").alias("v")))

    def tested(pairs: DataFrame) -> DataFrame:
        """Pairs that pass the union sketch, then the exact index."""
        u = pairs.join(unique.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(unique.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
        likely = checkpointed(u.where(both >= F.size(union) * F.lit(bound)).select("a", "b"))
        ids = likely.select(F.col("a").alias("k")).union(likely.select("b")).distinct()
        wanted = key_filter(ids, slots, broadcast_limit)
        sets = (some if wanted is None else some.where(may_have(wanted, slots)(key_hash(some["k"])))).mapInArrow(_sets(words), "k bigint, d binary, g binary")
        sets = sets.join(unique.join(ids, "k", "left_semi").select("k", "d"), ["k", "d"], "left_semi").dropDuplicates(["k"])
        sides = likely.join(sets.select(F.col("k").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("k").alias("b"), F.col("g").alias("gb")), "b")
        return checkpointed(sides.select("a", "b", "ga", "gb").mapInArrow(_exact(jaccard), "a bigint, b bigint"))

    heads = postings.groupBy("v").agg(F.min_by("k", F.xxhash64("v", "k")).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1").select("v", "h")
    first = postings.join(heads, "v").where("k <> h").select(F.least("k", "h").alias("a"), F.greatest("k", "h").alias("b")).distinct()
    first = checkpointed(first)
    links = tested(first)
    roots = common.components(links)
    placed = postings.join(roots, "k", "left").select("v", "k", F.coalesce("root", "k").alias("c"))
    mixed = checkpointed(placed.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("v", "m"))
    rest = placed.join(mixed.where(F.col("m") <= short), "v").groupBy("v").applyInArrow(_across, "a bigint, b bigint")
    long = mixed.where(F.col("m") > short).select("v", F.ceil(F.col("m") / block).cast("int").alias("nb"))
    if not long.isEmpty():
        cut = placed.join(F.broadcast(long) if long.count() <= 10_000 else long, "v").withColumn("b", F.pmod(F.xxhash64("k", "v"), F.col("nb")).cast("int"))
        cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("v", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "k", "c")
        rest = rest.unionByName(cut.join(unique.select("k", "s"), "k").groupBy("v", "x", "y").applyInArrow(_blocks(k, bound), "a bigint, b bigint"))
    rest = rest.distinct().join(first, ["a", "b"], "left_anti")
    return links.unionByName(tested(rest)).unionByName(copies)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows (keep_id, doc_id): each document that goes, with the least doc_id of its group, which stays.

    Cases: texts are compared by their word 3-grams, in lower case and without ASCII punctuation. A text of one or two
    words has one n-gram; texts without words equal only exact copies of themselves, the empty text included. A null
    text or key belongs to no group. Of rows that repeat a key the text of the least digest counts. Groups
    are connected components, so ties need no rule; the least key stays. Keys may be of any type that has an order. Other
    columns are ignored. An empty table gives no rows.
    """
    coded, codes = common.coded(docs.select(docs[key].alias("k"), docs[text].alias("x")), "k")
    groups = common.components(near_pairs(coded, common.slots_of(docs), **options))
    return common.decoded(groups.select(F.col("root").alias("keep_id"), F.col("k").alias("doc_id")), codes, "keep_id", "doc_id")


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_limit: int = BROADCAST_LIMIT, **options) -> DataFrame:
    """``docs``, all columns, without those that ``near_groups`` lets go. Rows that repeat a key share its fate.

    Only rows whose key a filter of the keys that go may have are joined with them; the others stay where they are.
    """
    gone = checkpointed(near_groups(docs, key, text, broadcast_limit=broadcast_limit, **options).select(F.col("doc_id").alias(common.fresh(docs, "gone"))))
    slots = common.slots_of(docs)
    suspected = key_filter(gone, slots, broadcast_limit)
    if suspected is None:
        return docs.join(gone, docs[key] == gone[gone.columns[0]], "left_anti")
    hit = may_have(suspected, slots)(key_hash(docs[key]))
    some = docs.where(hit)
    return docs.where(~hit).unionAll(some.join(gone, some[key] == gone[gone.columns[0]], "left_anti"))

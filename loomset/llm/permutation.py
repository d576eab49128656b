"""Approximate nearest neighbours by a permutation index.

A vector is represented by the list of its nearest pivots in order. Pivots are the axes of a random rotation, in both
directions, so they need no sample, don't grow with the table, and half of them, as a list, hold most of what a vector's
direction is. Each vector is posted in the inverted files of its first pivots; a query asks those of more of its own first pivots.
A file ranks its postings by the footrule distance of the lists and reranks them by the exact cosine in that order, a
share at first and then as many again, until that brings no posting among a query's best: little where lists tell vectors apart,
more in tight clusters, whose members have almost the same lists.
Files above a size are cut into blocks of postings times blocks of queries, so a hot pivot is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm import common
from loomset.session import checkpointed

K, SEED, LEAST_PIVOTS = 10, 11, 128
#: Rows whose key is divisible by this are queries.
EVERY = 20
#: Shares of the pivots that a vector is listed by, posted under, and asks; share of a file that is reranked first, and the least number.
LISTED, POSTED, ASKED, SHARE, LEAST = 0.5, 5 / 128, 24 / 128, 1 / 32, 24
#: Postings of one block of a file.
BLOCK = 16_384


def pivots(dim: int, seed: int = SEED) -> np.ndarray:
    """Unit vectors: the axes of a random rotation and their opposites; of several rotations, if one gives fewer than LEAST_PIVOTS."""
    random = np.random.default_rng(seed)
    axes = [np.linalg.qr(random.normal(size=(dim, dim)))[0] for _ in range(-(-LEAST_PIVOTS // (2 * dim)))]
    return np.vstack([a for q in axes for a in (q, -q)]).astype(np.float32)


def sizes(p: int) -> tuple[int, int, int]:
    """Pivots that a vector is listed by, posted under, and asks, of ``p``."""
    return max(1, round(p * LISTED)), max(1, round(p * POSTED)), max(1, round(p * ASKED))


def lists(x: np.ndarray, dim: int) -> np.ndarray:
    """Each unit vector's pivots, nearest first; of equally near ones the lower number first."""
    return np.argsort(-(x @ pivots(dim).T).round(5), axis=1, kind="stable")


def footrule(ranks: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Footrule distance between a query's list and those of postings, less what is the same for all postings.

    A pivot outside a list has the list's length as rank. ``ranks`` has a row for each pivot and a column for each posting. As a
    list's ranks have a fixed sum, sum |r - s| is 2 * sum(max(r, s)) over the query's list plus a constant.
    """
    kind = np.uint16 if len(asked) < 256 else np.uint32
    return np.maximum(ranks[asked], np.arange(len(asked), dtype=ranks.dtype)[:, None]).sum(0, dtype=kind)


def _posted(batches):
    """Each vector under the first pivots of its dimension: those it is posted under and, if it is a query, those it asks."""
    for batch in batches:
        length = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(length).tolist():
            listed, posted, asked = sizes(len(pivots(dim)))
            b = batch.filter(pa.array(length == dim))
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.linalg.norm(flat, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            x = (flat[ok] / norm[ok, None]).astype(np.float32)
            ids, query = b.column(0).filter(pa.array(ok)), b.column(1).to_numpy(zero_copy_only=False)[ok]
            order = lists(x, dim)
            n = np.where(query, max(posted, asked), posted)
            own = np.repeat(np.arange(len(x)), n)
            rank = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            head = pa.array([r.tobytes() for r in order[:, :listed].astype(np.uint16)], pa.binary())
            vec = pa.array([r.tobytes() for r in x], pa.binary())
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), dim, np.int32)), pa.array(order[own, rank].astype(np.int32)), pa.array(rank < posted), pa.array(query[own] & (rank < asked)), ids.take(at), head.take(at), vec.take(at)],
                ["dim", "p", "posts", "asks", "k", "head", "vec"],
            )


def nearest(q: int, ids: np.ndarray, vec: np.ndarray, mine: np.ndarray, order: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and similarities of the ``k`` best postings for a query of key ``q``, best first, and how many were reranked.

    ``order`` has the postings by footrule distance. Each step reranks as many as all steps before; the first one that
    brings nothing among the best is the last.
    """
    best, near, a, z = np.zeros(0, np.int64), np.zeros(0), 0, first
    while a < len(order):
        some = order[a:z]
        some = some[ids[some] != q]
        sims = np.append(near, (vec[some] @ mine).astype(np.float64).round(6))
        both = np.append(best, some)
        top = np.lexsort((ids[both], -sims))[:k]
        full = len(best) == k
        done = full and bool((top < k).all())
        best, near = both[top], sims[top]
        if done:
            return best, near, min(z, len(order))
        a, z = z, 2 * z
    return best, near, len(order)


def _answered(k: int, share: float, least: int):
    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        p = len(pivots(dim))
        listed, _, _ = sizes(p)
        role, ids = t["role"].to_numpy(), t["k"].to_numpy()
        head = np.frombuffer(b"".join(t["head"].to_pylist()), np.uint16).reshape(-1, listed)
        vec = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float32).reshape(-1, dim)
        o, q = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        o = o[np.argsort(ids[o])]  # postings of equal distance are taken by key
        own, mine = ids[o], vec[o]
        ranks = np.full((p, len(o)), listed, np.uint8 if listed < 256 else np.uint16)
        ranks[head[o], np.arange(len(o))[:, None]] = np.arange(listed, dtype=ranks.dtype)
        first = max(least, int(np.ceil(share * len(o))))
        left, right, near = [], [], []
        for i in q.tolist() if len(o) else ():
            order = np.argsort(footrule(ranks, head[i]), kind="stable")
            best, sims, _ = nearest(ids[i], own, mine, vec[i], order, k, first)
            left.append(np.full(len(best), ids[i]))
            right.append(own[best])
            near.append(sims)
        return pa.table({"vec_id": np.concatenate([ids[:0], *left]), "neighbour_id": np.concatenate([ids[:0], *right]), "similarity": np.concatenate([np.zeros(0), *near])})

    return run


def neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, share: float = SHARE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, neighbour_id, similarity, rank): of each query the ``k`` nearest other rows by cosine, found approximately.

    Queries are the rows whose key is divisible by ``every`` (keys that aren't whole numbers: whose number among the sorted
    keys is); every row is posted.

    Cases: vectors that are null, empty, of zero length, or have null or infinite elements, have no neighbours and are
    nobody's; so have rows with a null key. Vectors of different dimensions aren't neighbours of each other; each dimension
    is searched by itself. Of rows that repeat a key the least vector counts. Equal similarities (to six decimals) are ordered by neighbour_id. With fewer than ``k``
    others there are fewer rows. Other columns are ignored. An empty table gives no rows.
    """
    rows, codes = common.coded(vectors.select(vectors[key].alias("k"), vectors[vector].alias("v")), "k")
    some = rows.where(F.col("k").isNotNull() & (F.size("v") > 0)).select("k", F.col("v").cast("array<double>").alias("v"))
    some = some.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    one = some.groupBy("k").agg(F.min("v").alias("v")).select("k", (F.col("k") % every == 0).alias("asks"), "v")
    posts = checkpointed(one.mapInArrow(_posted, "dim int, p int, posts boolean, asks boolean, k bigint, head binary, vec binary"))
    files = posts.groupBy("dim", "p").agg(F.ceil(F.count_if("posts") / block).cast("int").alias("nb"), F.ceil(F.count_if("asks") / block).cast("int").alias("nq"))
    # at most a row a pivot of each dimension, a number that doesn't grow with the table
    files = F.broadcast(files.select("dim", "p", F.greatest("nb", F.lit(1)).alias("nb"), F.greatest("nq", F.lit(1)).alias("nq")))
    ob, qb = (F.pmod(F.xxhash64("k"), F.col(n)).cast("int") for n in ("nb", "nq"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda o, q, role: F.struct(o.cast("int").alias("ob"), q.cast("int").alias("qb"), F.lit(role).alias("role"))
    none = F.array().cast("array<struct<ob:int,qb:int,role:int>>")
    where = F.concat(F.when(F.col("posts"), F.transform(each("nq"), lambda i: place(ob, i, 1))).otherwise(none), F.when(F.col("asks"), F.transform(each("nb"), lambda i: place(i, qb, 2))).otherwise(none))
    where = F.when((F.col("nb") == 1) & (F.col("nq") == 1), F.array(F.struct(F.lit(0).alias("ob"), F.lit(0).alias("qb"), (F.col("posts").cast("int") + 2 * F.col("asks").cast("int")).alias("role")))).otherwise(where)
    shape = "vec_id bigint, neighbour_id bigint, similarity double"
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))

    def answers(rows: DataFrame) -> DataFrame:
        placed = rows.join(files, ["dim", "p"]).select("dim", "p", "k", "head", "vec", F.explode(where).alias("w")).select("dim", "p", "w.ob", "w.qb", "w.role", "k", "head", "vec")
        return placed.groupBy("dim", "p", "ob", "qb").applyInArrow(_answered(k, share, least), shape)

    def ranked(found: DataFrame) -> DataFrame:
        merged = found.groupBy("vec_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
        return merged.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)

    near = checkpointed(ranked(answers(posts)))
    # a query whose files hold too few others asks all files of its dimension, and so meets every vector of it
    n = posts.groupBy("dim").agg(F.countDistinct("k").alias("n"))
    served = near.groupBy("vec_id").agg(F.count(F.lit(1)).alias("served"))
    lacking = posts.where("asks").dropDuplicates(["k"]).join(served, F.col("k") == F.col("vec_id"), "left").join(n, "dim").where(F.coalesce("served", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("dim", "k", "head", "vec")
    lacking = checkpointed(lacking)
    if not lacking.isEmpty():
        count = F.col("dim") * 2 * F.ceil(F.lit(LEAST_PIVOTS) / (F.col("dim") * 2))
        asking = lacking.select("dim", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("p"), F.lit(False).alias("posts"), F.lit(True).alias("asks"), "k", "head", "vec")
        near = ranked(near.drop("rank").unionByName(answers(posts.where("posts").withColumn("asks", F.lit(False)).unionByName(asking))))
    return common.decoded(near, codes, "vec_id", "neighbour_id")

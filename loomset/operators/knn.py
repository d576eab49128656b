"""Exact nearest neighbours, their votes, and the effective rank of an embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a task, least queries of one, tasks that share the work, least pairs of one where there are fewer; queries and
#: candidates that meet at once, and pairs whose exact cosine is computed at once.
BLOCK, LEAST, TASKS, PAIRS = 1 << 15, 4096, 64, 1 << 27
ROWS, COLUMNS, AT_ONCE = 512, 2048, 1 << 15


def neighbours(vectors: DataFrame, key: str, vector: str, k: int = 10, block: int | None = None) -> DataFrame:
    """Rows (key, neighbour, rank): the k others of greatest cosine, equal ones (to six decimals) by key.

    All pairs are looked at: a task has a block of queries, and the candidates stream through it in chunks. Single precision tells which
    can be among the k best; only their exact cosines are computed, and a task gives k rows a query. Blocks grow with the table up to
    ``BLOCK``, so rows are copied a fixed number of times until then. Rows without key or vector have no neighbours and are none.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    n, d = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    block = block or min(BLOCK, max(LEAST, -(-n // 24)), max(LEAST, (256 << 20) // (8 * max(1, d))))
    blocks = max(1, -(-n // block))
    parts = max(1, min(-(-TASKS // blocks), n * block // PAIRS))
    kind = np.float32 if vectors.schema[vector].dataType.elementType.typeName() == "float" else np.float64
    cells = rows.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast(f"array<{'float' if kind is np.float32 else 'double'}>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    sent = cells.mapInArrow(_sent(blocks, parts, d, kind), "task int, asks boolean, ids binary, x binary")
    met = sent.repartitionById(blocks * parts, F.col("task")).sortWithinPartitions("task", F.desc("asks"))
    found = met.mapInArrow(_met(k, d, kind), "key bigint, neighbour bigint, similarity double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("key", "neighbour", "rank")


def _sent(blocks: int, parts: int, d: int, kind):
    """Chunks of rows (k, v, b): as queries for all tasks of their block, as candidates for one task of each block."""

    def chunk(tasks, asks, ids, x):
        n = len(tasks)
        return pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array([asks] * n), pa.array([ids.tobytes()] * n, pa.binary()), pa.array([x.tobytes()] * n, pa.binary())], ["task", "asks", "ids", "x"])

    def run(batches):
        turn = TaskContext.get().partitionId()
        for b in batches:
            ids, v, own = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
            if (np.diff(v.offsets.to_numpy()) != d).any():
                raise ValueError("vectors are of several lengths")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(ids), d)
            for q in np.unique(own).tolist():
                yield chunk([q * parts + p for p in range(parts)], True, ids[own == q], x[own == q])
            for a in range(0, len(ids), COLUMNS):
                turn += 1
                for q in range(blocks):  # a batch each: many blocks of one chunk aren't held at once
                    yield chunk([q * parts + (turn + q) % parts], False, ids[a : a + COLUMNS], x[a : a + COLUMNS])

    return run


def _met(k: int, d: int, kind):
    """The k best candidates of each query of a task; its queries come first."""

    def run(batches):
        task, asked, nearest = None, [], None
        for b in batches:
            for t, asks, ids, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t != task:
                    if nearest is not None:
                        yield from nearest.rows()
                    task, asked, nearest = t, [], None
                part = np.frombuffer(ids, np.int64), _unit(np.frombuffer(x, kind).reshape(-1, d) if d else np.zeros((len(ids) // 8, 0)))
                if asks:
                    asked.append(part)
                    continue
                if nearest is None and asked:
                    nearest, asked = Nearest(*(np.concatenate(c) for c in zip(*asked, strict=True)), k), []
                if nearest is not None:
                    nearest.meet(*part)
        if nearest is not None:
            yield from nearest.rows()

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Nearest:
    """Of each query the k best candidates so far, by cosine to six decimals, then by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k, self.small = ids, x, k, x.astype(np.float32)
        self.near, self.who = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        # by what cosines of single precision can be off, twice, and the sixth decimal
        self.slack = np.float32(2 * (x.shape[1] + 8) * 2.0**-24 + 2e-6)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        small = np.ascontiguousarray(x.astype(np.float32).T)
        for a in range(0, len(self.ids), ROWS):
            s = self.small[a : a + ROWS] @ small
            least = self.near[a : a + ROWS, -1].astype(np.float32)
            free = np.flatnonzero(least == -np.inf)
            if len(free) and len(ids) > self.k:  # the k-th of this chunk bounds those that haven't k candidates yet
                f = s[free]
                f[np.isnan(f) | (self.ids[a + free, None] == ids)] = -np.inf
                least[free] = np.partition(f, len(ids) - self.k, axis=1)[:, -self.k]
            mask = np.zeros((len(s), -(-len(ids) // 8) * 8), bool)
            np.greater_equal(s, (least - self.slack)[:, None], out=mask[:, : len(ids)])
            at = np.flatnonzero(mask.view(np.uint64))
            for lo in range(0, len(at), AT_ONCE // 8):
                some = at[lo : lo + AT_ONCE // 8]
                which, bit = np.nonzero(mask.reshape(-1, 8)[some])
                q, c = np.divmod(some[which] * 8 + bit, mask.shape[1])
                q += a
                exact = np.einsum("ij,ij->i", self.x[q], x[c]).round(6)
                ok = (exact >= self.near[q, -1]) & (self.ids[q] != ids[c])
                self._take(q[ok], exact[ok], ids[c[ok]])

    def _take(self, q: np.ndarray, near: np.ndarray, who: np.ndarray) -> None:
        if not len(q):
            return
        have = np.unique(q)
        q = np.concatenate([np.repeat(have, self.k), q])
        near, who = np.concatenate([self.near[have].ravel(), near]), np.concatenate([self.who[have].ravel(), who])
        order = np.lexsort((who, -near, q))
        first = np.searchsorted(q[order], have)
        best = order[first[:, None] + np.arange(self.k)]
        self.near[have], self.who[have] = near[best], who[best]

    def rows(self):
        for a in range(0, len(self.ids), BLOCK):
            near = self.near[a : a + BLOCK]
            ok = near > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids[a : a + BLOCK], ok.sum(1))), pa.array(self.who[a : a + BLOCK][ok]), pa.array(near[ok])], ["key", "neighbour", "similarity"])


def votes(near: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Rows (key, predicted): the label most neighbours have, of equals the least."""
    counts = near.join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("l")), "neighbour").groupBy("key", "l").count()
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("count"), "l"))
    return counts.withColumn("r", best).where("r = 1").select("key", F.col("l").alias("predicted"))


def rank_me(vectors: DataFrame, vector: str) -> float:
    """Exponential of the entropy of the singular values' shares; Gram matrices are summed, only one d x d matrix is collected."""

    def gram(batches):
        total = None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([i for i in range(len(total))], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(gram, "i int, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    if not sums:
        return 0.0
    d = max(r["i"] for r in sums) + 1
    m = np.zeros((d, d))
    for r in sums:
        m[r["i"], r["j"]] = r["x"]
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(m), 0))
    p = s / s.sum() + 1e-7
    return float(np.exp(-(p * np.log(p)).sum()))


def top_accuracy(near: DataFrame, labels: DataFrame, key: str, label: str, top: int) -> DataFrame:
    """One row (macro_accuracy, accuracy): how often a row's label is among the ``top`` most frequent of its neighbours (of equals the least)."""
    counts = near.join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("l")), "neighbour").groupBy("key", "l").count()
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("count"), "l"))
    hits = counts.withColumn("r", best).where(F.col("r") <= top).join(labels.select(F.col(key).alias("key"), F.col(label).alias("own")), "key")
    each = hits.groupBy("key", "own").agg(F.max((F.col("l") == F.col("own")).cast("double")).alias("hit"))
    by = each.groupBy("own").agg(F.avg("hit").alias("a"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.avg("a").alias("macro_accuracy"), (F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("accuracy"))


def gram(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows (i, j, x) of the sum of outer products, i <= j; as many as the square of the dimension."""
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    each = v.select(F.posexplode("v").alias("i", "a"), "v").select("i", "a", F.posexplode("v").alias("j", "b")).where("i <= j")
    return each.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("x"))


def lidar(vectors: DataFrame, vector: str, label: str, delta: float = 1e-4) -> float:
    """Effective rank of the between-class scatter whitened by the within-class one; sums are aggregated, the d x d matrices are on the driver."""

    def sums(batches):
        total: dict = {}
        for b in batches:
            x, y = np.array(b.column(0).to_pylist(), float), b.column(1).to_pylist()
            for c in set(y):
                rows = x[[i for i, k in enumerate(y) if k == c]]
                n, s, m = total.get(c, (0, 0.0, 0.0))
                total[c] = (n + len(rows), s + rows.sum(0), m + rows.T @ rows)
        for c, (n, s, m) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["c", "n", "s", "m"])

    rows = vectors.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(vector).cast("array<double>"), F.col(label).cast("bigint")).mapInArrow(sums, "c bigint, n bigint, s array<double>, m array<double>")
    flat = rows.select("c", "n", F.posexplode(F.concat("s", "m")).alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    if not flat:
        return 0.0
    size = max(r["i"] for r in flat) + 1
    d = int((np.sqrt(4 * size + 1) - 1) / 2)
    classes: dict = {}
    for r in flat:
        classes.setdefault(r["c"], (r["n"], np.zeros(size)))[1][r["i"]] = r["x"]
    means = np.stack([v[:d] / n for n, v in classes.values()])
    within = sum(v[d:].reshape(d, d) - np.outer(v[:d], v[:d]) / n for n, v in classes.values()) / sum(n for n, _ in classes.values()) + delta * np.eye(d)
    away = means - means.mean(0)
    w, q = np.linalg.eigh(within)
    half = q / np.sqrt(w) @ q.T
    e = np.maximum(np.linalg.eigvalsh(half @ (away.T @ away / len(means)) @ half), 0)
    p = e / e.sum() + 1e-7 if e.sum() > 0 else np.full(d, 1e-7)
    return float(np.exp(-(p * np.log(p)).sum()))


def macro_accuracy(truth_and_prediction: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row (macro_accuracy, accuracy): mean of the classes' shares of right predictions, and of all rows'."""
    by = truth_and_prediction.groupBy(label).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("a"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.avg("a").alias("macro_accuracy"), (F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("accuracy"))

"""Quality rules learned as a hashed n-gram logistic regression.

Byte 3- and 4-grams and word 1- and 2-grams are hashed into one table of weights. A text's score is the mean weight of its
n-grams of each kind, summed over the kinds, plus a bias: all texts of an Arrow batch are scored by gathers and segment
sums. The model is trained in one task on a bounded, hash-chosen sample of labelled rows, and Platt scaling on held-out rows
makes probabilities of the scores; fixed thresholds on these decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.llm import common, textkit

#: Bits of the weight table; labelled rows a class that training looks at, at most; share of them held out.
BITS, PER_CLASS, HELD_OUT = 18, 1500, 5
#: Kept from this probability of good quality; from SURE_GOOD the grade is good, between it is borderline.
KEEP, SURE_GOOD = 0.5, 0.9
STEPS, RATE, DECAY = 120, 0.5, 1e-5
KINDS = 4
#: Added to the number of n-grams of each kind, so that a few n-grams alone don't decide on a short text.
SHRINK = np.array([120, 120, 20, 20])
#: A very long text is scored in parts of about so many bytes, whose n-gram sums add up to those of the whole.
PART = 1 << 22
#: N-gram cells of the training rows that are looked at together, at most.
CELLS = 1 << 20


def _kinds(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: table index of each, and the n+1 offsets of the texts among them."""
    shift = np.uint32(32 - bits)
    wide = buf.astype(np.uint32)
    pair = wide[:-1] | wide[1:] << np.uint32(8)
    three = pair[:-1] | wide[2:] << np.uint32(16)
    for n, gram in ((3, three), (4, three[:-1] | wide[3:] << np.uint32(24))):
        h = gram * np.uint32(0x9E3779B1) ^ (gram >> np.uint32(15)) * np.uint32(0x85EBCA77 + n)
        h *= np.uint32(0xC2B2AE3D)
        # n-grams that reach over a text's end belong to no text
        ends = np.maximum(offsets[1:] - 1 - (n - 1), offsets[:-1])
        yield (h >> shift).astype(np.int32), np.stack([np.minimum(offsets[:-1], len(h)), np.minimum(ends, len(h))])
    starts, stops = textkit.word_spans(buf)
    at = np.searchsorted(starts, offsets)
    h = textkit.span_hashes(buf, starts, stops)
    top = np.uint64(64 - bits)
    yield (textkit.mix(h + np.uint64(1)) >> top).astype(np.int32), np.stack([at[:-1], at[1:]])
    # a word right after itself is one n-gram whatever the word is
    two = np.where(h[:-1] == h[1:], np.uint64(1), textkit.mix(h[:-1] * np.uint64(0x9DDFEA08EB382D69) + h[1:]))
    yield (two >> top).astype(np.int32), np.stack([np.minimum(at[:-1], len(two)), np.minimum(np.maximum(at[1:] - 1, at[:-1]), len(two))])


def _sums(w: np.ndarray, idx: np.ndarray, span: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(w[idx], dtype=np.float64)])
    return c[span[1]] - c[span[0]]


def _parts(t: bytes) -> Iterator[tuple[bytes, int]]:
    """A very long text in parts that end at white space: what n-grams that start in the part need, and the part's length."""
    a = 0
    while a < len(t):
        z = _BLANK.search(t, a + PART)
        z = z.start() if z else len(t)
        follows = _WORD.search(t, z)
        yield t[a : max(z + 3, follows.end() if follows else 0)], z - a
        a = z


_BLANK, _WORD = re.compile(rb"[ \t\n\r]"), re.compile(rb"[^ \t\n\r]+")


def means(w: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the kinds of each text's shrunk mean weight, and whether it has any word."""
    out, inked = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for i, j in textkit.chunks(texts):
        if j - i == 1 and len(texts[i]) > PART:
            total, count = np.zeros(KINDS), np.zeros(KINDS)
            for part, n in _parts(texts[i]):
                buf, offsets = textkit.joined([part])
                if len(buf) < 8:
                    buf = np.concatenate([buf, np.full(8, 10, np.uint8)])
                words = int(np.searchsorted(textkit.word_spans(buf)[0], n))
                for k, (idx, span) in enumerate(_kinds(buf, offsets)):
                    span = np.minimum(span, n if k < 2 else words)
                    total[k] += _sums(w, idx, span)[0]
                    count[k] += span[1, 0] - span[0, 0]
            out[i], inked[i] = (total / (count + SHRINK)).sum(), count[2] > 0
            continue
        buf, offsets = textkit.joined(texts[i:j])
        if len(buf) < 8:
            buf = np.concatenate([buf, np.full(8, 10, np.uint8)])
        for k, (idx, span) in enumerate(_kinds(buf, offsets)):
            n = span[1] - span[0]
            out[i:j] += _sums(w, idx, span) / (n + SHRINK[k])
            if k == 2:
                inked[i:j] = n > 0
    return out, inked


def fit(texts: list[bytes], y: np.ndarray, held: np.ndarray) -> dict:
    """Weights, bias and Platt scaling. Rows with ``held`` set only calibrate."""
    if len(set(y[~held].tolist())) < 2:
        p = float(y.mean()) if len(y) else 1.0
        return {"w": np.zeros(1 << BITS, np.float32), "bias": 0.0, "a": 0.0, "b": float(np.log((p + 1e-3) / (1 - p + 1e-3)))}
    blocks = []  # first text, cells of each text, their columns and values: small arrays, so that nothing as long as all cells is copied
    for i, j in textkit.chunks(texts):
        buf, offsets = textkit.joined(texts[i:j])
        if len(buf) < 8:
            buf = np.concatenate([buf, np.full(8, 10, np.uint8)])
        for kind, (idx, span) in enumerate(_kinds(buf, offsets)):
            n = span[1] - span[0]
            take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(span[0], n)
            cell = np.repeat(np.arange(j - i), n).astype(np.int64) << BITS | idx[take]
            cell, count = np.unique(cell, return_counts=True)
            r = cell >> BITS
            col, val = (cell & ((1 << BITS) - 1)).astype(np.int32), (count / (n[r] + SHRINK[kind])).astype(np.float32)
            for a in range(0, len(r), CELLS):
                b = slice(a, a + CELLS)
                blocks.append((i, np.bincount(r[b], minlength=j - i).astype(np.int32), col[b], val[b]))

    def odds() -> np.ndarray:
        z = np.zeros(len(y))
        for i, n, col, val in blocks:
            z[i : i + len(n)] += np.bincount(np.repeat(np.arange(len(n)), n), w[col] * val, len(n))
        return z

    w, bias = np.zeros(1 << BITS), 0.0
    train = ~held
    balance = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * train
    g2, b2 = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(STEPS):
        z = odds() + bias
        e = (1 / (1 + np.exp(-z)) - y) * balance
        g = DECAY * w
        for i, n, col, val in blocks:
            g += np.bincount(col, np.repeat(e[i : i + len(n)], n) * val, 1 << BITS)
        g2 += g * g
        b2 += e.sum() ** 2
        w -= RATE * g / np.sqrt(g2)
        bias -= RATE * e.sum() / np.sqrt(b2)
    z = odds() + bias
    a, b = platt(z[held], y[held]) if len(set(y[held].tolist())) == 2 else (1.0, 0.0)
    return {"w": w.astype(np.float32), "bias": float(bias), "a": a, "b": b}


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Damped Newton fit of p = sigmoid(a z + b), with Platt's smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones(len(z))])
    theta = np.array([1.0, 0.0])
    loss = lambda c: (np.logaddexp(0, c @ x) - t * (c @ x)).sum() + 1e-3 * (c @ c)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        grad = x @ (p - t) + 2e-3 * theta
        hess = (x * (p * (1 - p))) @ x.T + 2e-3 * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        # a full step overshoots where the classes are far apart
        while loss(theta - size * step) > loss(theta) and size > 1e-6:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(theta[0]), float(theta[1])


def probabilities(model: dict, texts: list[bytes]) -> np.ndarray:
    """Probability of good quality; 0 for a text without words."""
    z, inked = means(model["w"], texts)
    p = 1 / (1 + np.exp(-np.clip(model["a"] * (z + model["bias"]) + model["b"], -30, 30)))
    return np.where(inked, p, 0.0)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    y, k, texts = [], [], []
    for b in batches:
        y += b.column(0).to_pylist()
        k += b.column(1).cast(pa.string()).to_pylist()
        texts += textkit.as_bytes(b.column(2))
    # whatever order the rows come in, the model is the same
    order = sorted(range(len(k)), key=lambda i: (k[i], texts[i]))
    held = np.arange(len(order)) % HELD_OUT == 0
    m = fit([texts[i] for i in order], np.array([y[i] for i in order], np.int64), held)
    yield pa.RecordBatch.from_arrays([pa.array([m["w"].tobytes()], pa.binary()), *(pa.array([m[c]], pa.float64()) for c in ("bias", "a", "b"))], ["w", "bias", "a", "b"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """Model of the quality label, trained by one task on up to ``per_class`` rows a class, which all tasks look for."""
    rows = common.labelled_sample(docs, labels, per_class, key, text, label)
    r = rows.repartition(1).mapInArrow(_trained, "w binary, bias double, a double, b double").first()
    if r is None:
        return fit([], np.zeros(0, np.int64), np.zeros(0, bool))
    return {"w": np.frombuffer(bytes(r["w"]), np.float32), "bias": r["bias"], "a": r["a"], "b": r["b"] + prior_shift(labels, key, label, per_class)}


def prior_shift(labels: DataFrame, key: str, label: str, per_class: int) -> float:
    """Log odds that take the probabilities from the sample's share of good rows to that of all labels."""
    one = labels.where(labels[key].isNotNull() & labels[label].isNotNull())
    n0, n1 = one.agg(F.count_if(labels[label] == 0), F.count_if(labels[label] != 0)).first()
    if not n0 or not n1:
        return 0.0
    return float(np.log(n1 / n0) - np.log(min(n1, per_class) / min(n0, per_class)))


def _scored(model, at: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probabilities(model.value, textkit.as_bytes(b.column(at))))], [f"c{i}" for i in range(b.num_columns + 1)])

    return run


def score(docs: DataFrame, model: dict, text: str = "text", into: str = "p_good") -> DataFrame:
    """``docs`` with the probability of good quality in a column ``into``, added last."""
    shape = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate([*(f.dataType for f in docs.schema.fields), T.DoubleType()])])
    run = _scored(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text))
    return common.positional(docs).mapInArrow(run, shape).toDF(*docs.columns, into)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = KEEP) -> DataFrame:
    """``docs``, all columns, where the probability of good quality reaches ``threshold``.

    Cases: a null text or one without words has no n-grams; its probability is 0 and it goes. Keys don't matter for
    scoring, so null and repeated keys are scored like others; of a labelled key that repeats the least text is trained on. A very
    long text is scored in parts that give the whole's n-grams. Without labels of both classes the share of good labels is
    everyone's probability; without any, everything with words stays. Ties don't arise: each row is decided alone. An empty
    table gives an empty table.
    """
    p = common.fresh(docs, "p_good")
    return score(docs, train(docs, labels, key, text, label), text, p).where(F.col(p) >= threshold).drop(p)


def kept_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = KEEP) -> DataFrame:
    """Rows (doc_id, p_good, grade) of the documents that stay: grade 'good' from SURE_GOOD, else 'borderline'."""
    scored = score(docs.select(key, text), train(docs, labels, key, text), text).where(F.col("p_good") >= threshold)
    return scored.select(F.col(key).alias("doc_id"), "p_good", F.when(F.col("p_good") >= SURE_GOOD, "good").otherwise("borderline").alias("grade"))

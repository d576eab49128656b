"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are cut into bins; each statistic has a table of one number a bin, and each chosen pair of statistics a table
of one number a cell. The tables are learned by cyclic boosting: in turn, each takes a small step along a shallow tree that is
fitted to the gradient by bin. A text's log odds are the sum of its table entries, so scoring is a few gathers a text, and every
table can be read as the effect of its statistic. Training sees a bounded, hash-chosen sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.llm import common, quality_rules, textkit
from loomset.llm.linededup import line_hashes

#: Labelled rows a class, at most; every HELD_OUT-th of them only calibrates.
PER_CLASS, HELD_OUT = 2000, 5
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_HESSIAN = 60, 40, 0.1, 0.2
#: Kept from this probability of good quality; from SURE_GOOD the grade is good, between it is borderline.
KEEP, SURE_GOOD = 0.5, 0.9

STATISTICS = ["bytes", "words", "letters", "digits", "upper", "foreign", "stops", "symbols", "spaces", "word_mean", "word_max", "word_spread", "short_words", "symbol_words", "stutter", "new_words", "new_bigrams", "lines", "line_mean", "new_lines", "entropy"]

_KIND = np.zeros(256, np.uint8)  # 0 symbols, 1 letters, 2 digits, 3 upper, 4 foreign, 5 stops, 6 spaces
_KIND[97:123], _KIND[48:58], _KIND[65:91], _KIND[128:] = 1, 2, 3, 4
_KIND[[44, 46, 59, 58, 39, 45, 63]] = 5
_KIND[[9, 10, 13, 32]] = 6


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each text."""
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text; zeros for one without words."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, j in textkit.chunks(texts):
        out[i:j] = _statistics(texts[i:j])
    return out


def _statistics(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    buf, offsets = textkit.joined(texts)
    size = np.diff(offsets) - 1
    inner = np.append(np.arange(len(buf)), 0)[: len(buf)]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    del inner
    kinds = np.stack([np.bincount(doc[_KIND[buf] == k], minlength=n) for k in range(7)], 1).astype(float)
    kinds[:, 6] -= 1  # the line feed that joins texts
    starts, ends = textkit.word_spans(buf)
    word_doc = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(word_doc, minlength=n)
    some = np.maximum(words, 1)
    long = (ends - starts).astype(float)
    h = textkit.span_hashes(buf, starts, ends)
    mean = np.bincount(word_doc, long, n) / some
    spread = np.sqrt(np.maximum(np.bincount(word_doc, long * long, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, word_doc, long)
    last = buf[np.maximum(ends - 1, 0)]
    symbol = np.isin(_KIND[last], (0,))
    same = (word_doc[1:] == word_doc[:-1]) & (h[1:] == h[:-1])
    pair_doc = word_doc[1:][word_doc[1:] == word_doc[:-1]]
    pair = (h[:-1] * np.uint64(0x9DDFEA08EB382D69) + h[1:])[word_doc[1:] == word_doc[:-1]]
    pairs = np.maximum(np.bincount(pair_doc, minlength=n), 1)
    lh, line_doc, _, a, z = line_hashes(texts)
    lines = np.bincount(line_doc, minlength=n)
    some_lines = np.maximum(lines, 1)
    counts = np.bincount(doc * 256 + buf, minlength=n * 256).reshape(n, 256).astype(float)
    counts[:, 10] -= 1
    p = counts / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
    share = kinds / np.maximum(size, 1)[:, None]
    out = np.stack(
        [
            np.log1p(size), np.log1p(words), share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 0], share[:, 6], mean, np.log1p(longest), spread,
            np.bincount(word_doc[long <= 3], minlength=n) / some, np.bincount(word_doc[symbol], minlength=n) / some, np.bincount(word_doc[1:][same], minlength=n) / some,
            _distinct(h, word_doc, n) / some, _distinct(pair, pair_doc, n) / pairs, np.log1p(lines), np.log1p(np.bincount(line_doc, (z - a).astype(float), n) / some_lines), _distinct(lh, line_doc, n) / some_lines, entropy,
        ],
        1,
    )
    out[words == 0] = 0
    return out


def edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of ordered bins; place 0: none."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    left, right = ch[:-1], ch[-1] - ch[:-1]
    ok = (left >= LEAST_HESSIAN) & (right >= LEAST_HESSIAN)
    if not ok.any():
        return 0.0, 0
    gain = np.where(ok, cg[:-1] ** 2 / np.maximum(left, 1e-9) + (cg[-1] - cg[:-1]) ** 2 / np.maximum(right, 1e-9) - cg[-1] ** 2 / max(ch[-1], 1e-9), -1)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step of each bin: the values of a tree of up to ``leaves`` leaves, each split where it gains most."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, k = max(((*_cut(g[a:z], h[a:z]), k) for k, (a, z) in enumerate(parts)), key=lambda x: x[0])
        if gain <= 1e-9 or not at:
            break
        a, z = parts[k]
        parts[k : k + 1] = [(a, a + at), (a + at, z)]
    out = np.empty(len(g))
    for a, z in parts:
        out[a:z] = -g[a:z].sum() / (h[a:z].sum() + 1.0)
    return out


def crossed(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that splits one axis and then each side by the other."""
    best = (0.0, np.zeros(g.shape))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for at in range(1, a.shape[0]):
            gain, step = 0.0, np.zeros(a.shape)
            for s in (slice(0, at), slice(at, None)):
                x, y = a[s].sum(0), b[s].sum(0)
                up, cut = _cut(x, y)
                gain += up
                for c in (slice(0, cut), slice(cut, None)) if cut else (slice(0, None),):
                    step[s, c] = -x[c].sum() / (y[c].sum() + 1.0)
            if gain > best[0]:
                best = (gain, step.T if flip else step)
    return best


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> dict:
    """Bin edges, tables, pairs with their tables, bias and Platt scaling; rows with ``held`` set only calibrate."""
    train = ~held
    model = {"edges": [], "tables": [], "pairs": [], "pair_edges": [], "pair_tables": [], "bias": 0.0, "a": 1.0, "b": 0.0}
    if len(set(y[train].tolist())) < 2:
        p = float(y.mean()) if len(y) else 1.0
        return model | {"a": 0.0, "b": float(np.log((p + 1e-3) / (1 - p + 1e-3)))}
    weight = np.where(y == 1, 0.5 / (y[train] == 1).mean(), 0.5 / (y[train] == 0).mean()) * train
    m = x.shape[1]
    model["edges"] = [edges(x[train, k], BINS) for k in range(m)]
    model["pair_edges"] = [edges(x[train, k], PAIR_BINS) for k in range(m)]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model["edges"])]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model["pair_edges"])]
    model["tables"] = [np.zeros(len(e) + 1) for e in model["edges"]]
    z = np.zeros(len(y))

    def gradient():
        p = 1 / (1 + np.exp(-z))
        return (p - y) * weight, p * (1 - p) * weight

    for _ in range(ROUNDS):
        for k in range(m):
            g, h = gradient()
            n = len(model["tables"][k])
            step = RATE * shallow(np.bincount(bins[k], g, n), np.bincount(bins[k], h, n))
            model["tables"][k] += step
            z += step[bins[k]]
    g, h = gradient()
    found = []
    for k in range(m):
        for q in range(k + 1, m):
            shape = (len(model["pair_edges"][k]) + 1, len(model["pair_edges"][q]) + 1)
            cell = coarse[k] * shape[1] + coarse[q]
            gain, _ = crossed(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))
            found.append((-gain, k, q, shape, cell))
    found = sorted(found, key=lambda f: f[:3])[:PAIRS]
    model["pairs"] = [(k, q) for _, k, q, _, _ in found]
    model["pair_tables"] = [np.zeros(shape) for *_, shape, _ in found]
    for _ in range(PAIR_ROUNDS):
        for table, (*_, shape, cell) in zip(model["pair_tables"], found, strict=True):
            g, h = gradient()
            size = shape[0] * shape[1]
            _, step = crossed(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape))
            table += RATE * step
            z += RATE * step.ravel()[cell]
    # tables are centred on the sample, so that each reads as a difference from the mean
    for table, b in [*zip(model["tables"], bins, strict=True), *((t.reshape(-1), f[-1]) for t, f in zip(model["pair_tables"], found, strict=True))]:
        mean = table[b[train]].mean()
        table -= mean
        model["bias"] += float(mean)
    if len(set(y[held].tolist())) == 2:
        model["a"], model["b"] = quality_rules.platt(z[held], y[held])
    return model


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Sum of the table entries of each row."""
    z = np.full(len(x), model["bias"])
    for k, (e, table) in enumerate(zip(model["edges"], model["tables"], strict=True)):
        z += table[np.searchsorted(e, x[:, k], side="right")]
    for (k, q), table in zip(model["pairs"], model["pair_tables"], strict=True):
        z += table[np.searchsorted(model["pair_edges"][k], x[:, k], side="right"), np.searchsorted(model["pair_edges"][q], x[:, q], side="right")]
    return z


def probabilities(model: dict, texts: list[bytes]) -> np.ndarray:
    """Calibrated probability of good quality; 0 for a text without words."""
    x = statistics(texts)
    p = 1 / (1 + np.exp(-np.clip(model["a"] * log_odds(model, x) + model["b"], -30, 30)))
    return np.where(x[:, 1] > 0, p, 0.0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """Model of the label: statistics of up to ``per_class`` rows a class are computed where the rows are, and fitted on the driver."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(textkit.as_bytes(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "k", "x"])

    rows = common.labelled_sample(docs, labels, per_class, key, text, label).mapInArrow(measured, "y int, k string, x array<double>").collect()
    rows.sort(key=lambda r: (r["k"], r["x"]))
    y = np.array([r["y"] for r in rows], np.int64)
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(STATISTICS))
    model = fit(x, y, np.arange(len(rows)) % HELD_OUT == 0)
    model["b"] += quality_rules.prior_shift(labels, key, label, per_class)
    return model


def score(docs: DataFrame, model: dict, text: str = "text", into: str = "p_good") -> DataFrame:
    """``docs`` with the probability of good quality in a column ``into``, added last."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probabilities(shared.value, textkit.as_bytes(b.column(at))))], [f"c{i}" for i in range(b.num_columns + 1)])

    shape = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate([*(f.dataType for f in docs.schema.fields), T.DoubleType()])])
    return common.positional(docs).mapInArrow(run, shape).toDF(*docs.columns, into)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = KEEP) -> DataFrame:
    """Rows (doc_id, p_good, grade) of the documents that stay: grade 'good' from SURE_GOOD, else 'borderline'.

    Cases: a null text or one without words has probability 0 and goes. Null and repeated keys are scored like others, row by
    row. Without labels of both classes the share of good labels is everyone's probability; without any, all with words
    stay. A statistic's value on a bin's edge is in the upper bin. Other columns are ignored. An empty table gives no rows.
    """
    scored = score(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), train(docs, labels, key, text)).where(F.col("p_good") >= threshold)
    return scored.select("doc_id", "p_good", F.when(F.col("p_good") >= SURE_GOOD, "good").otherwise("borderline").alias("grade"))

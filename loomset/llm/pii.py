"""Personal data and secrets found by a linear-chain conditional random field over word shapes.

The model is trained on a small labelled table that ``labelled_table`` writes out of patterns. Tokens, their shapes, gaps and words
are hashed in numpy for a whole chunk of texts. A token at which every best path must be outside, whatever stands around it, is
settled from its emission alone (the bound is exact); only runs of the other tokens go through Viterbi, many
runs in one step, so the result is that of Viterbi over the whole text.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomset.llm import textkit

LABELS = ["O", "EMAIL", "PHONE", "IP", "CARD", "SECRET"]
#: Kinds whose neighbouring tokens are one finding; of the others each token is one.
JOINED = {2, 4}
ROWS, SEED = 1500, 5
STEPS, RATE, DECAY = 120, 0.4, 3e-4

_OWN = b".@-+()_/"
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 57, 65, 97, 97
for _c in _OWN:
    _CLASS[_c] = _c
_MASK = np.zeros(256, np.uint16)
for _k, _group in enumerate((b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"@", b".", b"-", b"+", b"(", b")", b"_/")):
    _MASK[list(_group)] = 1 << _k
_GAP = np.zeros(256, np.uint16)
for _k, _group in enumerate((b"\n", b"=", b"\"'`", b":", b"|,;", b"!?#$%&*~^<>[]{}\\")):
    _GAP[list(_group)] = 1 << _k
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LENGTHS = np.minimum(np.arange(64), 20)
_LENGTHS[20:32], _LENGTHS[32:] = 20, 21


def _bucket(n: np.ndarray) -> np.ndarray:
    return _LENGTHS[np.minimum(n, 63)].astype(np.uint64)


def tokens(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, digits and ``.@-+()_/``, without full stops around them."""
    edge = np.flatnonzero(np.diff((_CLASS[buf] > 0).astype(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    solid = np.flatnonzero((_CLASS[buf] > 0) & (buf != 46))
    if not len(solid):
        return starts[:0], ends[:0]
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends) - 1
    keep = last >= first
    return solid[first[keep]], solid[last[keep]] + 1


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each token the hashes of its exact shape, coarse shape, characters with length, lower-case word, gap before, and characters."""
    n = len(starts)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    size = ends - starts
    token = np.repeat(np.arange(n), size)
    kind = _CLASS[buf[at]]
    new = np.ones(len(at), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (token[1:] != token[:-1])
    run = np.flatnonzero(new)
    long = np.diff(np.append(run, len(at)))
    first = np.searchsorted(token[run], np.arange(n))
    powers, _ = textkit._powers(len(run) + 1)
    weight = powers[np.arange(len(run)) - first[token[run]]]
    c = kind[run].astype(np.uint64)
    fine = np.add.reduceat(textkit.mix(c * np.uint64(64) + _bucket(long) + np.uint64(1)) * weight, first)
    coarse = np.add.reduceat(textkit.mix(c + np.uint64(1)) * weight, first)
    chars = np.bitwise_or.reduceat(_MASK[buf[at]], np.searchsorted(token, np.arange(n))).astype(np.uint64)
    word = textkit.span_hashes(_LOWER[buf], starts, ends)
    before = np.append(0, ends[:-1])
    gap = np.zeros(n, np.uint64)
    wide = np.flatnonzero(starts - before != 1)
    single = np.setdiff1d(np.arange(n), wide, assume_unique=True)
    gap[single] = _GAP[buf[before[single]]]
    for i in wide.tolist() if len(wide) < 64 else []:
        gap[i] = np.bitwise_or.reduce(_GAP[buf[before[i] : starts[i]]], initial=np.uint16(0))
    if len(wide) >= 64:
        full = wide[starts[wide] > before[wide]]
        pair = np.stack([before[full], starts[full]], 1).ravel()
        gap[full] = np.bitwise_or.reduceat(np.append(_GAP[buf], 0), pair)[0::2]
    return np.stack([textkit.mix(fine), textkit.mix(coarse + np.uint64(7)), textkit.mix(chars * np.uint64(64) + _bucket(size)), word, textkit.mix(gap + np.uint64(3)), textkit.mix(chars + np.uint64(11))])


#: (base feature, offset of the token that it is taken from)
USED = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (0, -1), (0, 1), (2, -1), (2, 1), (3, -1), (4, 1), (5, 0), (5, -1), (5, 1)]


class _Table:
    """Places of hashes in a sorted array: a table by their upper bits, and a search for those whose slot is taken."""

    BITS = 17

    def __init__(self, known: np.ndarray):
        self.known, self.shift = known, np.uint64(64 - self.BITS)
        slot = (known >> self.shift).astype(np.int64)
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(known), dtype=np.int32)[::-1]
        spilled = np.flatnonzero(self.slots[slot] != np.arange(len(known)))
        self.spilled, self.places = known[spilled], spilled

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or the number of known ones."""
        if not len(self.known):
            return np.zeros(len(h), np.int64)
        at = self.slots[(h >> self.shift).astype(np.int64)]
        hit = (at >= 0) & (self.known[at] == h)
        out = np.where(hit, at, len(self.known)).astype(np.int64)
        more = np.flatnonzero((at >= 0) & ~hit) if len(self.spilled) else ()
        if len(more):
            k = np.minimum(np.searchsorted(self.spilled, h[more]), len(self.spilled) - 1)
            out[more] = np.where(self.spilled[k] == h[more], self.places[k], len(self.known))
        return out


class Crf:
    """Dictionaries of the base features, emission weights by used feature, transitions, and weights of the first label."""

    def __init__(self, known: list[np.ndarray], emission: list[np.ndarray], transition: np.ndarray, first: np.ndarray):
        self.known, self.emission, self.transition, self.first = known, emission, transition, first
        self.tables = [_Table(h) for h in known]

    def ids(self, f: np.ndarray) -> list[np.ndarray]:
        """Number of each base feature, or that of the row of zeros."""
        return [table.find(h) for h, table in zip(f, self.tables, strict=True)]

    def emissions(self, ids: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
        n = len(doc)
        e = np.zeros((n, len(LABELS)), np.float32)
        for (base, offset), w in zip(USED, self.emission, strict=True):
            e += w[shifted(ids[base], doc, offset, len(w) - 1)]
        return e

    def decode(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Best labels of the texts' token sequences."""
        n, t = len(doc), self.transition
        out = np.zeros(n, np.int64)
        if not n:
            return out
        gain = [max(max(0, (t[:, y] - t[:, 0]).max(), self.first[y] - self.first[0]) + max(0, (t[y] - t[0]).max()), 0) for y in range(1, len(LABELS))]
        settled = e[:, 0] > (e[:, 1:] + np.array(gain, np.float32)).max(1) + 1e-3
        open_ = np.flatnonzero(~settled)
        if not len(open_):
            return out
        begins = np.ones(len(open_), bool)
        begins[1:] = (np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]])
        start = open_[begins]
        stop = open_[np.append(np.flatnonzero(begins)[1:], len(open_)) - 1] + 1
        order = np.argsort(start - stop, kind="stable")
        start, stop = start[order], stop[order]
        size = stop - start
        head = (start == 0) | (doc[np.maximum(start - 1, 0)] != doc[start])
        tail = (stop == n) | (doc[np.minimum(stop, n - 1)] != doc[start])
        back = []
        v = e[start] + np.where(head[:, None], self.first[None], t[0][None])
        score = v
        ends = v.copy()
        for k in range(1, int(size[0])):
            m = int(np.searchsorted(-size, -k, side="left"))  # runs of more than k tokens
            paths = score[:m, :, None] + t[None]
            back.append(paths.argmax(1))
            score = paths.max(1) + e[start[:m] + k]
            ends[:m] = score
        last = (ends + np.where(tail[:, None], 0, t[:, 0][None])).argmax(1)
        for k in range(int(size[0]) - 1, -1, -1):
            m = int(np.searchsorted(-size, -k, side="left"))
            out[start[:m] + k] = last[:m]
            if k:
                last[:m] = back[k - 1][np.arange(m), last[:m]]
        return out


def shifted(ids: np.ndarray, doc: np.ndarray, offset: int, none: int) -> np.ndarray:
    """The id at ``offset`` from each token in the same text, or ``none``."""
    if not offset:
        return ids
    at = np.arange(len(doc)) + offset
    ok = (at >= 0) & (at < len(doc))
    at = np.clip(at, 0, max(0, len(doc) - 1))
    return np.where(ok & (doc[at] == doc), ids[at], none)


def labelled_table(rows: int = ROWS, seed: int = SEED) -> pa.Table:
    """The labelled rows (text, starts, ends, kinds; character offsets) that the model is trained on."""
    r = random.Random(seed)
    syllables = "the er in on re an hat lich keit ung ein sch ver que los ción mente ado eau ment est our ä ü ñ é and of".split()

    def word():
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        return w.capitalize() if r.random() < 0.2 else w

    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    quad = lambda: ".".join(str(r.randint(0, r.choice([9, 99, 255, 255]))) for _ in range(4))

    def email():
        local = r.choice([name(), f"{name()}.{name()}", f"{name()}.{r.randint(1, 99)}", f"{name()}_{name()}", f"{name()}+{name()}", f"{word().lower()}.{r.randint(1, 99)}", f"{word()}{word()}.{r.randint(1, 99)}".lower(), f"{name()}{r.randint(1, 999)}", f"{name()}.{name()}.{name()}"])
        return f"{local}@{r.choice([f'mail{r.randint(0, 9)}', name(), f'{name()}-{name()}', f'{name()}.{name()}'])}.{r.choice(['example.com', 'com', 'org', 'net', 'de', 'co.uk', 'example.org'])}"

    def phone():
        return r.choice(
            [f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+1 ({digits(3)}) 555-{digits(4)}", f"+1 ({digits(3)}) 555-{digits(4)}", f"+{r.randint(1, 99)} {digits(2)} {digits(7)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}"]
        )

    def card():
        four = r.choice("3456") + digits(15)
        return r.choice([four, four, four, " ".join(four[i : i + 4] for i in range(0, 16, 4)), "-".join(four[i : i + 4] for i in range(0, 16, 4))])

    def secret():
        key = r.choice(["token", "token", "key", "secret", "api_key", "password", "access_token"])
        value = r.choice([hexes(40), hexes(40), hexes(32), hexes(64), "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randint(24, 40)))])
        return key, value

    harmless = [
        lambda: digits(r.randint(1, 12)), lambda: digits(r.randint(1, 7)), lambda: f"{r.randint(0, 99)}.{digits(2)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
        lambda: f"{word()}/{word()}", lambda: f"({word()})", lambda: f"{word()}-{word()}", lambda: f"({digits(4)})", lambda: f"{word().upper()}-{digits(3)}", lambda: hexes(7), lambda: f"{word()} = {digits(2)}", lambda: f'{word()} = "{word()}"',
        lambda: f"+ {digits(1)}", lambda: "@" + name(), lambda: f"token {word()}", lambda: f"{digits(2)}/{digits(2)}/20{digits(2)}", lambda: f"{digits(3)} {digits(3)}",
    ]
    table = []
    for _ in range(rows):
        parts: list[tuple[str, str, str, str]] = []  # before, text, after, kind
        for _ in range(r.randint(4, 16)):
            parts.append(("", word(), r.choice(["", "", "", "", ",", ".", "\n"]), "O"))
        for _ in range(r.randint(0, 3)):
            at, kind = r.randint(0, len(parts)), r.choice(["EMAIL", "PHONE", "IP", "CARD", "SECRET", "O", "O", "O"])
            tail = r.choice(["", "", "", ".", ",", " |", "\n"])
            if kind == "SECRET":
                key, value = secret()
                quote = r.choice(['"', '"', "'", ""])
                parts.insert(at, (f"{key} {r.choice(['=', '=', ':'])} {quote}", value, quote + tail, kind))
            else:
                make = {"EMAIL": email, "PHONE": phone, "IP": quad, "CARD": card}.get(kind) or r.choice(harmless)
                parts.insert(at, ("", make(), tail, kind))
        junk, upper = r.choice(["", "", "", "", "", "!!", "###", "%%%", "***", "$$$"]), r.random() < 0.12
        text, starts, ends, kinds = "", [], [], []
        for before, body, after, kind in parts:
            text += before
            if kind != "O":
                starts.append(len(text))
                kinds.append(kind)
            text += body
            if kind != "O":
                ends.append(len(text))
            text += after + (junk if r.random() < 0.7 else "") + " "
        table.append((text.upper() if upper and len(text.upper()) == len(text) else text, starts, ends, kinds))
    columns = list(zip(*table, strict=True))
    return pa.table({"text": pa.array(columns[0]), "starts": pa.array(columns[1], pa.list_(pa.int64())), "ends": pa.array(columns[2], pa.list_(pa.int64())), "kinds": pa.array(columns[3], pa.list_(pa.string()))})


def char_offsets(buf: np.ndarray) -> np.ndarray:
    """Characters before each byte."""
    return np.append(0, np.cumsum((buf & 0xC0) != 0x80))


def gold(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base features, text index and label of each token of a labelled table."""
    texts = [t.encode() for t in table["text"].to_pylist()]
    buf, offsets = textkit.joined(texts)
    starts, ends = tokens(buf)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    chars = char_offsets(buf)
    a, z = chars[starts] - chars[offsets[doc]], chars[ends] - chars[offsets[doc]]
    y = np.zeros(len(starts), np.int64)
    for k, (s, e, kinds) in enumerate(zip(table["starts"].to_pylist(), table["ends"].to_pylist(), table["kinds"].to_pylist(), strict=True)):
        lo, hi = np.searchsorted(doc, [k, k + 1])
        for i, j, kind in zip(s, e, kinds, strict=True):
            y[lo:hi][(a[lo:hi] < j) & (z[lo:hi] > i)] = LABELS.index(kind)
    return features(buf, starts, ends), doc, y


def fit(table: pa.Table) -> Crf:
    """Maximum likelihood with a little weight decay, by gradient steps scaled to each weight's history."""
    f, doc, y = gold(table)
    k, n, docs = len(LABELS), len(doc), int(doc.max()) + 1
    known, ids = [], []
    for h in f:
        values, back = np.unique(h, return_inverse=True)
        known.append(values)
        ids.append(back)
    used = [shifted(ids[base], doc, offset, len(known[base])) for base, offset in USED]
    at = np.arange(n) - np.searchsorted(doc, doc)
    grid = np.full((int(at.max()) + 1, docs), -1)
    grid[at, doc] = np.arange(n)
    there = grid >= 0
    size = there.sum(0)
    weights = [np.zeros((len(known[base]) + 1, k)) for base, _ in USED]
    params = [*weights, np.zeros((k, k)), np.zeros(k)]
    history = [np.full(p.shape, 1e-8) for p in params]
    truth = np.eye(k)[y]
    follows = np.zeros((k, k))
    np.add.at(follows, (y[:-1][doc[:-1] == doc[1:]], y[1:][doc[:-1] == doc[1:]]), 1)
    first = truth[grid[0][there[0]]].sum(0)
    for _ in range(STEPS):
        t, start = params[-2], params[-1]
        e = sum(w[u] for w, u in zip(weights, used, strict=True))
        eg = np.where(there[:, :, None], e[grid], 0)
        alpha, beta = np.zeros_like(eg), np.zeros_like(eg)
        alpha[0] = eg[0] + start
        for i in range(1, len(grid)):
            x = alpha[i - 1][:, :, None] + t[None]
            top = x.max(1, keepdims=True)
            alpha[i] = np.where(there[i][:, None], np.log(np.exp(x - top).sum(1)) + top[:, 0] + eg[i], alpha[i - 1])
        for i in range(len(grid) - 2, -1, -1):
            x = t[None] + (eg[i + 1] + beta[i + 1])[:, None, :]
            top = x.max(2, keepdims=True)
            beta[i] = np.where(there[i + 1][:, None], np.log(np.exp(x - top).sum(2)) + top[:, :, 0], beta[i])
        z = np.log(np.exp(alpha[-1] - alpha[-1].max(1, keepdims=True)).sum(1)) + alpha[-1].max(1)
        p = np.zeros((n, k))
        p[grid[there]] = np.exp(alpha + beta - z[None, :, None])[there]
        pairs = np.zeros((k, k))
        for i in range(len(grid) - 1):
            m = there[i + 1]
            pairs += np.exp(alpha[i][m][:, :, None] + t[None] + (eg[i + 1] + beta[i + 1])[m][:, None, :] - z[m][:, None, None]).sum(0)
        grads = [np.stack([np.bincount(u, (p - truth)[:, c], len(w)) for c in range(k)], 1) for w, u in zip(weights, used, strict=True)]
        grads += [pairs - follows, p[grid[0][there[0]]].sum(0) - first]
        for w, g, h in zip(params, grads, history, strict=True):
            g = g / docs + DECAY * w
            h += g * g
            w -= RATE * g / np.sqrt(h)
        for w in weights:
            w[-1] = 0
    del size
    return Crf(known, [w.astype(np.float32) for w in weights], params[-2].astype(np.float32), params[-1].astype(np.float32))


@cache
def model(rows: int = ROWS, seed: int = SEED) -> Crf:
    return fit(labelled_table(rows, seed))


def find(crf: Crf, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, start and end byte within the text, and label of each finding."""
    out = []
    for i, j in textkit.chunks(texts):
        buf, offsets = textkit.joined(texts[i:j])
        starts, ends = tokens(buf)
        if not len(starts):
            continue
        doc = np.searchsorted(offsets, starts, side="right") - 1
        y = crf.decode(crf.emissions(crf.ids(features(buf, starts, ends)), doc), doc)
        hit = np.flatnonzero(y)
        if not len(hit):
            continue
        begins = np.ones(len(hit), bool)
        begins[1:] = (np.diff(hit) > 1) | (y[hit[1:]] != y[hit[:-1]]) | (doc[hit[1:]] != doc[hit[:-1]]) | ~np.isin(y[hit[1:]], list(JOINED))
        a = hit[begins]
        z = hit[np.append(np.flatnonzero(begins)[1:], len(hit)) - 1]
        base = offsets[doc[a]]
        out.append((doc[a] + i, starts[a] - base, ends[z] - base, y[a]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def masked(text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    parts, done = [], 0
    for a, z, y in spans:
        parts += [text[done:a], b"[" + LABELS[y].encode() + b"]"]
        done = z
    return b"".join([*parts, text[done:]])


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_found, found, text) of the documents in which something is found, in one pass without a shuffle.

    ``found`` lists structs (kind, start, stop) in order, in characters of the original; ``text`` has each replaced by
    its kind in brackets.

    Cases: a null, empty or blank text has nothing. Nothing joins rows, so repeated rows and null keys are treated like
    others. Long texts are decoded whole. Labels of equal score: the first of LABELS wins. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    crf = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        for b in batches:
            texts = textkit.as_bytes(b.column(1))
            doc, a, z, y = find(crf.value, texts)
            rows, at = np.unique(doc, return_index=True)
            lists, new = [], []
            for r, lo, hi in zip(rows.tolist(), at.tolist(), [*at.tolist(), len(doc)][1:], strict=True):
                spans = list(zip(a[lo:hi].tolist(), z[lo:hi].tolist(), y[lo:hi].tolist(), strict=True))
                chars = char_offsets(np.frombuffer(texts[r], np.uint8))
                lists.append([{"kind": LABELS[k], "start": int(chars[s]), "stop": int(chars[e])} for s, e, k in spans])
                new.append(masked(texts[r], spans).decode())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, pa.list_(struct)), pa.array(new, pa.string())], ["doc_id", "n_found", "found", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key], docs[text]).mapInArrow(run, f"doc_id {kind}, n_found bigint, found array<struct<kind:string,start:bigint,stop:bigint>>, text string")

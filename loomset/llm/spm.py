"""SentencePiece segmentation over the piece lattice: N-best encoding and exact decoding.

A text is normalised as the model asks (a space in front, spaces as U+2581). No piece crosses the start of a
run of U+2581 or a character that the vocabulary lacks, so the lattice falls apart into units, and a text's best
paths are sums of its units'. A unit is solved once per worker: a forward Viterbi pass, and a backward one
that gives the gap to its second-best path. N-best paths come from A-star search backwards from the unit's end,
with the forward scores as exact heuristics, only for the few units of a text whose gaps can matter; a
best-first merge over the units then gives the text's N-best segmentations.

The model is a BPE model: its scores are ranks of merges, not likelihoods that add up. A piece of rank r gets the log-probability
of Zipf's law, 1 / (r + ZIPF) over the sum of all, and a piece that the tokenizer itself doesn't put at that place costs FOREIGN more,
which is beyond any sum of log-probabilities. So the best path is the tokenizer's own segmentation, and the others
follow by the number of pieces in which they depart from it, the likeliest first.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomset.llm import common, textkit

#: Where the public vocabularies are, unless LOOMSET_TOKENIZERS names another folder.
MODEL = os.path.join(os.environ.get("LOOMSET_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
NBEST = 3
#: Added to the ranks in the log-probabilities of pieces; cost of a piece that the tokenizer doesn't use there.
ZIPF, FOREIGN = 10, 1e6
#: A character that the vocabulary lacks costs this much more than the worst piece, and becomes byte pieces.
UNKNOWN = 10.0
#: Units that a worker remembers, beyond which it forgets the rare ones, and that it solves at once.
REMEMBER, AT_ONCE = 150_000, 16_000
SPACE = "▁"


class Lattice:
    """Pieces and scores of a model, and best paths of units."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        n = m.get_piece_size()
        self.pieces = m.id_to_piece(list(range(n)))
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.processor = m
        ranks = {i: min(float(n), -m.get_score(i)) for i in plain}
        norm = np.log(sum(1 / (r + ZIPF) for r in ranks.values()))
        self.score = {self.pieces[i]: float(-np.log(r + ZIPF) - norm) for i, r in ranks.items()}
        self.merge = {self.pieces[i]: m.get_score(i) for i in plain}
        self.width = np.array([len(p) for p in self.pieces])
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.score.values()) - UNKNOWN
        known = re.escape("".join(c for c in self.ids if len(c) == 1 and c != SPACE))
        # a run of spaces with what follows, or what stands first, or one character that no piece has
        self.units = re.compile(f"{SPACE}+[{known}]*|[{known}]+|.", re.DOTALL)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this model cross words")
        self.index, self.parts = Numbering(), []
        self.uses = np.zeros(0, np.int64)
        self.alternatives: dict[str, list] = {}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.scores = np.full(n + 1, -np.inf)  # the last is for what is no piece
        self.scores[plain] = [self.score[self.pieces[i]] for i in plain]
        self.hashes = np.zeros(n, np.uint64)
        for i in plain:
            c, (_, inverse) = self.prefix(np.frombuffer(self.pieces[i].encode("utf-32-le"), np.uint32))
            self.hashes[i] = textkit.mix(c[-1:] * inverse[:1])[0]
        # a table of 2**20 slots by the hash's upper bits; pieces whose slot is taken are searched for
        self.slots = np.full(1 << 20, -1, np.int64)
        spilled = []
        for i in plain:
            at = int(self.hashes[i] >> np.uint64(44))
            if self.slots[at] < 0:
                self.slots[at] = i
            else:
                spilled.append(i)
        spilled.sort(key=lambda i: self.hashes[i])
        self.spilled, self.spilled_ids = self.hashes[spilled], np.array(spilled, np.int64)

    def cuts(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces that the tokenizer cuts units into: unit, end within it, and length of each."""
        plain = [k for k, u in enumerate(units) if len(u) > 1 and u[0] == SPACE and SPACE not in u[1:]]
        at, rest = np.array(plain, np.int64), set(range(len(units))) - set(plain)
        size = self.width[self.processor.encode(" ".join([units[k][1:] for k in plain]), num_threads=1)] if plain else np.zeros(0, np.int64)
        stop, end = np.cumsum([len(units[k]) for k in plain], dtype=np.int64), np.cumsum(size)
        if len(stop) and (len(end) == 0 or end[-1] != stop[-1] or not np.isin(stop, end).all()):
            at, size, end, stop, rest = at[:0], size[:0], end[:0], stop[:0], range(len(units))
        who = np.searchsorted(stop, end)
        begin = np.append(0, stop)[who] if len(who) else who
        parts = [(at[who] if len(who) else who, end - begin, size)]
        for k in rest:
            m = self.merged(units[k])
            parts.append((np.full(len(m), k), np.cumsum(m), np.array(m)))
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))

    def own(self, unit: str) -> list[int]:
        """Lengths of the pieces that the tokenizer cuts a unit into."""
        return self.cuts([unit])[2].tolist()

    def merged(self, unit: str) -> list[int]:
        """The same by the merges themselves: of all neighbours that make a piece the best, then the leftmost, merge first."""
        parts = list(unit)
        heap = [(-s, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (s := self.merge.get(a + b)) is not None]
        heapq.heapify(heap)
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] else -1
            if j < 0 or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (s := self.merge.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, parts[a] + parts[b]))
        return [len(p) for p in parts if p]

    def edges(self, unit: str, sizes: list[int] | None = None) -> list[tuple[int, int, float]]:
        """Edges (start, end, score) by end, then start; ``sizes`` are the lengths of the tokenizer's pieces, if they are known."""
        score, longest, out = self.score, self.longest, []
        own, end = set(), 0
        for n in self.own(unit) if sizes is None else sizes:
            own.add((end, end + n))
            end += n
        for j in range(1, len(unit) + 1):
            for i in range(max(0, j - longest), j):
                s = score.get(unit[i:j])
                if s is not None:
                    out.append((i, j, s if (i, j) in own else s - FOREIGN))
            if unit[j - 1] not in score:
                out.append((j - 1, j, self.unknown))
        return out

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        i = self.ids.get(piece)
        return (i,) if i is not None else tuple(self.bytes[b] for b in piece.encode())

    def forward(self, unit: str, edges: list) -> tuple[list[float], list[int]]:
        best, back = [0.0] + [-np.inf] * len(unit), [0] * (len(unit) + 1)
        for i, j, s in edges:
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, i
        return best, back

    def solve(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        """Ids of the best path, its score, and how much less the second-best path scores (infinite if there is none)."""
        edges = self.edges(unit)
        best, back = self.forward(unit, edges)
        n = len(unit)
        rest = [-np.inf] * n + [0.0]
        for i, j, s in reversed(edges):
            if s + rest[j] > rest[i]:
                rest[i] = s + rest[j]
        on, j, ids = set(), n, ()
        while j:
            i = back[j]
            on.add((i, j))
            ids = self.piece_ids(unit[i:j]) + ids
            j = i
        other = max((best[i] + s + rest[j] for i, j, s in edges if (i, j) not in on), default=-np.inf)
        return ids, best[n], best[n] - other

    def nbest(self, unit: str, n: int, sizes: list[int] | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths (score, ids), best first: backward A-star with exact heuristics.

        Of equally good states the one nearest to the start goes on first, so ties don't make the search longer.
        """
        edges = self.edges(unit, sizes)
        best, _ = self.forward(unit, edges)
        into: list[list] = [[] for _ in range(len(unit) + 1)]
        for i, j, s in edges:
            into[j].append((i, s))
        heap, out = [(0.0, len(unit), 0.0, ())], []
        while heap and len(out) < n:
            _, j, g, ids = heapq.heappop(heap)
            if j == 0:
                out.append((g, ids))
                continue
            for i, s in into[j]:
                if best[i] > -np.inf:
                    heapq.heappush(heap, (round(-(best[i] + s + g), 6), i, s + g, self.piece_ids(unit[i:j]) + ids))
        return out

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def decode(self, ids) -> str:
        """Text of the ids: byte pieces are bytes, U+2581 becomes a space, the space in front goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, or -1."""
        at = self.slots[(h >> np.uint64(44)).astype(np.int64)]
        hit = (at >= 0) & (self.hashes[at] == h)
        out = np.where(hit, at, -1)
        more = np.flatnonzero((at >= 0) & ~hit)
        if len(more):
            k = np.minimum(np.searchsorted(self.spilled, h[more]), len(self.spilled) - 1)
            out[more] = np.where(self.spilled[k] == h[more], self.spilled_ids[k], -1)
        return out

    def solve_all(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``solve`` for many units at once: concatenated ids, their number, score and gap of each unit.

        Units are sorted by falling length, so that those that reach a position come first: every step, a piece
        length at a position, is a few numpy operations over them. Substrings are looked up by hash.
        """
        size = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-size, kind="stable")
        size, most = size[order], int(size.max())
        code = np.frombuffer("".join([units[k] for k in order.tolist()]).encode("utf-32-le"), np.uint32)
        rank = np.repeat(np.arange(len(units)), size)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        prefix = np.zeros((most + 1, len(units)), np.uint64)
        powers, inverse = textkit._powers(most + 1)
        prefix[place + 1, rank] = (code.astype(np.uint64) + np.uint64(1)) * powers[place]
        np.cumsum(prefix, axis=0, out=prefix)
        reach = np.searchsorted(-size, -np.arange(most + 1), side="right")  # units of so many characters at least
        best = np.full((most + 1, len(units)), -np.inf)
        rest = best.copy()
        best[0], rest[size, np.arange(len(units))] = 0.0, 0.0
        step, piece, own = np.zeros(best.shape, np.int8), np.zeros(best.shape, np.int32), np.zeros(best.shape, np.int8)
        who, end, length = self.cuts([units[k] for k in order.tolist()])
        own[end, who] = length
        scores: dict[tuple[int, int], np.ndarray] = {}
        for a in range(1, most + 1):
            m = reach[a]
            for n in range(min(a, self.longest), 0, -1):
                ids = self.lookup(textkit.mix((prefix[a, :m] - prefix[a - n, :m]) * inverse[a - n]))
                s = self.scores[ids] - FOREIGN * (own[a, :m] != n)
                v = best[a - n, :m] + s
                up = np.flatnonzero(v > best[a, :m])
                if len(up):
                    best[a, up], step[a, up], piece[a, up] = v[up], n, ids[up]
                scores[a, n] = s
        for a in range(most, 0, -1):
            m = reach[a]
            for n in range(min(a, self.longest), 0, -1):
                np.maximum(rest[a - n, :m], scores[a, n] + rest[a, :m], out=rest[a - n, :m])
        at = size.copy()
        for a in range(most, 0, -1):
            m = reach[a]
            on = at[:m] == a
            step[a, :m] *= on
            at[:m] -= step[a, :m]
        other = np.full(len(units), -np.inf)
        for (a, n), s in scores.items():
            m = reach[a]
            v = best[a - n, :m] + s + rest[a, :m]
            v[step[a, :m] == n] = -np.inf
            np.maximum(other[:m], v, out=other[:m])
        total = best[size, np.arange(len(units))]
        who, a = np.nonzero(step.T)
        back = np.empty(len(units), np.int64)
        back[order] = np.arange(len(units))
        count = np.bincount(who, minlength=len(units))
        begin = (np.cumsum(count) - count)[back]
        count = count[back]
        stop = np.cumsum(count)
        flat = piece[a, who][np.arange(len(who)) + np.repeat(begin - stop + count, count)]
        return flat, count, total[back], (total - other)[back]

    def prefix(self, code: np.ndarray):
        powers = textkit._powers(len(code) + 1)
        c = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * powers[0][: len(code)], out=c[1:])
        return c, powers

    def learn(self, units: list[str]) -> None:
        """Add solved units to the tables that ``encode`` gathers from."""
        known = [u for u in units if len(u) <= 64 and (len(u) > 1 or u in self.score)]
        flat, n, total, gap = self.solve_all(known) if known else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        if len(known) < len(units):  # very long units, and characters without a piece
            rows, k, parts = set(known), 0, np.split(flat, np.cumsum(n)[:-1]) if known else []
            both = []
            for u in units:
                if u in rows:
                    both.append((parts[k], total[k], gap[k]))
                    k += 1
                else:
                    ids, a, b = self.solve(u)
                    both.append((np.array(ids, np.int32), a, b))
            flat, n = np.concatenate([x[0] for x in both]), np.array([len(x[0]) for x in both])
            total, gap = (np.array([x[c] for x in both], float) for c in (1, 2))
        self.parts.append((flat, n, total, gap))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
        return self.parts[0]

    def forget(self) -> None:
        """Keep the units that came up again, the most used ones if they are more than a third of what may be remembered."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > REMEMBER // 3:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: REMEMBER // 3]])
        flat, size, total, gap = self.tables()
        begin, m = (np.cumsum(size) - size)[keep], size[keep]
        flat = flat[np.arange(m.sum()) + np.repeat(begin - np.cumsum(m) + m, m)]
        units = list(self.index)
        self.index = Numbering((units[k], n) for n, k in enumerate(keep.tolist()))
        self.parts, self.uses = [(flat, m, total[keep], gap[keep])] if len(keep) else [], self.uses[keep] // 2
        self.alternatives = {u: p for u, p in self.alternatives.items() if u in self.index}

    def encode_all(self, texts: list[str], n: int = NBEST) -> list[list[tuple[float, np.ndarray]]]:
        """The n best segmentations of each text as (score, ids), best first.

        Of equal scores the one comes first that changes the earlier unit.
        """
        if len(self.index) > REMEMBER:
            self.forget()
        units = [self.units.findall(self.normal(t)) for t in texts]
        have = len(self.index)
        where = [np.fromiter(map(self.index.__getitem__, u), np.int64, len(u)) for u in units]
        if len(self.index) > have:
            new = list(self.index)[have:]
            for k in range(0, len(new), AT_ONCE):
                self.learn(new[k : k + AT_ONCE])
        uses = np.bincount(np.concatenate([np.zeros(0, np.int64), *where]), minlength=len(self.index))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        if not self.parts:
            return [[(0.0, np.zeros(0, np.int32))] for _ in texts]
        flat, size, total, gap = self.tables()
        begin = np.cumsum(size) - size
        return [self.best_of(u, w, n, flat, size, begin, total, gap) for u, w in zip(units, where, strict=True)]

    def best_of(self, units, where, n, flat, size, begin, total, gap) -> list[tuple[float, np.ndarray]]:
        m = size[where]
        stop = np.cumsum(m)
        ids = flat[np.arange(m.sum()) + np.repeat(begin[where] - stop + m, m)]
        score = float(total[where].sum())
        out = [(score, ids)]
        # only the n - 1 units that change most cheaply can change in the n best
        gaps = gap[where]
        few = np.flatnonzero(np.isfinite(gaps))
        if n == 1 or not len(few):
            return out
        if len(few) > n - 1:
            edge = np.partition(gaps[few], n - 2)[n - 2]
            few = few[gaps[few] <= edge]
            few = few[np.argsort(gaps[few], kind="stable")][: n - 1]
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for at in np.sort(few).tolist():
            u = units[at]
            if u not in self.alternatives:
                mine = tuple(ids[stop[at] - m[at] : stop[at]].tolist())
                ranked = self.nbest(u, n, self.width[list(mine)].tolist())
                self.alternatives[u] = [(ranked[0][0], mine), *[p for p in ranked if p[1] != mine][: n - 1]]
            paths = self.alternatives[u]
            sums = heapq.nsmallest(n, ((d + paths[0][0] - s, (*c, (at, p)) if k else c) for d, c in sums for k, (s, p) in enumerate(paths)), key=lambda x: (x[0], [a for a, _ in x[1]]))
        for d, changes in sums[1:]:
            parts, done = [], 0
            for at, p in changes:
                parts += [ids[done : stop[at] - m[at]], np.array(p, np.int32)]
                done = stop[at]
            out.append((score - d, np.concatenate([*parts, ids[done:]])))
        return out

    def encode(self, text: str, n: int = NBEST) -> list[tuple[float, np.ndarray]]:
        return self.encode_all([text], n)[0]


class Numbering(dict):
    """Numbers keys as they come up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_LATTICES: dict[str, Lattice] = {}


def lattice(model: str) -> Lattice:
    """One lattice per worker process and model."""
    if model not in _LATTICES:
        _LATTICES[model] = Lattice(model)
    return _LATTICES[model]


def _encoded(model: str, n: int, at: int, flush: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(model)
        for b in batches:
            sizes = [len(t or "") for t in b.column(at).to_pylist()]
            start, size = 0, 0
            for k, x in enumerate(sizes):
                size += x
                if size >= flush or k + 1 == len(sizes):
                    yield _batch(b.slice(start, k + 1 - start), m, n, at)
                    start, size = k + 1, 0

    return run


def _lists(values: list) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))


def _batch(b: pa.RecordBatch, m: Lattice, n: int, at: int) -> pa.RecordBatch:
    texts = b.column(at).to_pylist()
    rows = m.encode_all([t or "" for t in texts], n)
    best = [r[0][1] for r in rows]
    outer = np.cumsum([0, *(len(r) - 1 for r in rows)]).astype(np.int32)
    others = pa.ListArray.from_arrays(pa.array(outer), _lists([i for r in rows for _, i in r[1:]]))
    exact = [None if t is None else m.decode(i.tolist()) == t.replace(SPACE, " ") for t, i in zip(texts, best, strict=True)]
    columns = [_lists(best), pa.array(list(map(len, best)), pa.int64()), pa.array([[s for s, _ in r] for r in rows], pa.list_(pa.float64())), others]
    null = b.column(at).is_null()
    if null.true_count:
        columns = [pc.if_else(null, pa.scalar(None, c.type), c) for c in columns]
    return pa.RecordBatch.from_arrays([*b.columns, *columns, pa.array(exact, pa.bool_())], [f"c{i}" for i in range(b.num_columns + 5)])


def encode(docs: DataFrame, text: str = "text", n: int = NBEST, model: str = MODEL) -> DataFrame:
    """``docs`` with the columns ids, n_tokens, scores, others, exact added last: no shuffle, one pass.

    ``ids`` is the best segmentation, which is the tokenizer's own, ``others`` are the next ``n`` - 1 (or all, if there are
    fewer), ``scores`` are the scores of all these, best first: log-probabilities, less FOREIGN for each piece that isn't the
    tokenizer's. ``exact`` says that decoding ``ids`` gives the text back.

    Cases: an empty text has no ids, one segmentation of score 0, and is exact; a null text has nulls. U+2581 in a
    text is read as a space, as the format has it. Of paths of equal score the one that changes an earlier unit comes
    first. Repeated rows are encoded alike. Columns of ``docs`` with these names are kept, and the new
    ones get names with underscores in front. An empty table gives an empty table.
    """
    added = [common.fresh(docs, c) for c in ("ids", "n_tokens", "scores", "others", "exact")]
    new = [T.ArrayType(T.IntegerType()), T.LongType(), T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.IntegerType())), T.BooleanType()]
    shape = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate([*(f.dataType for f in docs.schema.fields), *new])])
    return common.positional(docs).mapInArrow(_encoded(model, n, docs.columns.index(text)), shape).toDF(*docs.columns, *added)


def decode(encoded: DataFrame, ids: str = "ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of ``ids`` in a column ``into``, added last; null ids give null, no ids the empty text."""
    at = encoded.columns.index(ids)

    def run(batches):
        m = lattice(model)
        for b in batches:
            texts = [None if i is None else m.decode(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [f"c{i}" for i in range(b.num_columns + 1)])

    shape = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate([*(f.dataType for f in encoded.schema.fields), T.StringType()])])
    return common.positional(encoded).mapInArrow(run, shape).toDF(*encoded.columns, common.fresh(encoded, into))

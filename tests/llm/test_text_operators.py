"""Operators on documents: odd rows, empty tables, clashing columns, and brute force or exact round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.llm import chaining, gam, linededup, minhash, mixing, pii, quality_rules, slots, spm


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- line dedup


def brute_lines(rows):
    seen, out = set(), {}
    for k, t in sorted((k, t) for k, t in rows if k is not None and t):
        kept = []
        for line in t.split("\n"):
            if not line.strip(" \t\r"):
                kept.append(line)
            elif line not in seen:
                seen.add(line)
                kept.append(line)
        out[k] = "\n".join(kept)
    return out


@pytest.mark.parametrize(("limit", "hot"), [(1 << 30, 10_000), (-1, 10_000), (1 << 30, 3)])
def test_line_dedup(spark, odd, empty, clashing, monkeypatch, limit, hot):
    monkeypatch.setattr(linededup, "HOT_LEAST", hot)
    rows = [(i, "\n".join(f"line {(i * 7 + j * j) % 23}" if j % 4 else "" for j in range(i % 9)), "en", "s", 0) for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(clashing(odd(rows)), broadcast_limit=limit).collect() if r["doc_id"] is not None and r["doc_id"] < 90}
    want = {k: "" for k, *_ in rows} | brute_lines([(k, t) for k, t, *_ in rows])
    assert got == want
    left = {(r["doc_id"], r["text"]) for r in linededup.dedup_lines(odd()).collect()}
    assert left == {(None, "a text without a key"), (90, None), (91, ""), (92, " \n\t"), (93, "one")}
    assert linededup.dedup_lines(empty).count() == 0


def test_lines_of_long_texts_repeated_keys_and_text_keys(spark, odd, empty):
    long = "\n".join(f"row {i % 5000} {'x' * (i % 70)}" for i in range(40_000))
    rows = [(1, "a b c\nonly here", "en", "s", 0), (1, "a b c\nand here", "en", "s", 0), (2, long, "en", "s", 0), (3, "a b c\nlast", "en", "s", 0)]
    got = {(r["doc_id"], r["text"]) for r in linededup.dedup_lines(odd(rows)).collect() if r["doc_id"] is not None and r["doc_id"] < 90}
    # both rows of key 1 hold the first occurrence, at the same place
    assert got == {(1, "a b c\nonly here"), (1, "a b c\nand here"), (2, brute_lines([(2, long)])[2]), (3, "last")}
    named = odd(rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {(r["doc_id"], r["text"]) for r in linededup.dedup_lines(named).collect() if r["doc_id"] in ("d1", "d2", "d3")} == {(f"d{k}", t) for k, t in got}


def test_texts_that_lose_no_line_do_not_shuffle(spark, odd):
    rows = [(i, f"unique {i}\n{'shared' if i < 4 else i}", "en", "s", 0) for i in range(80)]
    out = linededup.dedup_lines(odd(rows))
    plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    kept = plan[plan.index("Union") :]
    assert kept.count("Exchange") == 2 and out.count() == 86  # the changed texts and their decisions, on one side of the union


def test_bloom_filters_miss_nothing():
    h = np.random.default_rng(0).integers(0, 1 << 62, 5000).astype(np.uint64)
    found = set(slots.suspects_of(np.concatenate([h, h[:100]])).tolist())
    assert set(h[:100].tolist()) <= found and len(found) < 150
    at = slots.slot_of(h, 7)
    filters = slots.Filters({s: slots.filter_of(h[:2000][at[:2000] == s]).tobytes() for s in range(6)}, 7)
    hit = filters.has(h)
    assert hit[:2000][at[:2000] < 6].all() and not hit[at == 6].any() and hit[2000:].mean() < 0.01
    assert hit.tolist() == [s < 6 and bool(slots.bloom_has(filters.bytes[filters.start[s] : filters.start[s] + int(filters.bits[s]) // 8], x[None])[0]) for s, x in zip(at, h, strict=True)]


# ---- near dedup


def shingle_sets(texts):
    return [set(s.tolist()) for s in minhash.shingles([minhash.textkit.folded(t) for t in texts])]


def brute_groups(rows):
    rows = sorted({(k, t) for k, t in rows if k is not None and t is not None})
    sets = shingle_sets([t for _, t in rows])
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, text) in enumerate(rows):
        for j in range(i):
            b, other = rows[j]
            if text == other or sets[i] & sets[j] and len(sets[i] & sets[j]) >= minhash.JACCARD * len(sets[i] | sets[j]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(find(k), k) for k, _ in rows if find(k) != k}


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": -1}, {"short": 3, "block": 4}])
def test_near_dedup(spark, odd, empty, clashing, prose, options):
    r = random.Random(1)
    rows = []
    for g in range(12):
        base = prose(g, 120).split()
        for c in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(c):
                w[r.randrange(len(w))] = f"new{g}{c}"
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    # texts that share a passage, some of them near each other and most not
    shared = prose(500, 50)
    rows += [(len(rows) + i, f"{shared} {prose(600 + i // 3, 60)}", "en", "s", 1) for i in range(30)]
    got = {(r["keep_id"], r["doc_id"]) for r in minhash.near_groups(odd(rows), **options).collect()}
    assert got == brute_groups([(x["doc_id"], x["text"]) for x in odd(rows).collect()])
    kept = minhash.drop_near(clashing(odd(rows)), **options)
    assert kept.columns == clashing(odd()).columns
    assert {r["doc_id"] for r in kept.collect()} == {x["doc_id"] for x in odd(rows).collect()} - {b for _, b in got}
    assert minhash.near_groups(empty, **options).count() == 0 and minhash.drop_near(empty, **options).count() == 0


def test_near_dedup_of_repeated_keys_text_keys_and_long_texts(spark, odd, prose):
    long = prose(1, 30_000)
    rows = [(1, prose(2, 80), "en", "s", 1), (1, prose(3, 80), "en", "s", 1), (2, prose(2, 80), "en", "s", 1), (3, prose(3, 80), "en", "s", 1), (4, long, "en", "s", 1), (5, long + " end", "en", "s", 1)]
    got = {(r["keep_id"], r["doc_id"]) for r in minhash.near_groups(odd(rows)).collect()}
    assert (4, 5) in got and len(got & {(1, 2), (1, 3)}) == 1 and len(got) == 2  # of key 1 one text counts
    named = odd(rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {(r["keep_id"], r["doc_id"]) for r in minhash.near_groups(named).collect()} == {(f"d{a}", f"d{b}") for a, b in got}
    assert {r["doc_id"] for r in minhash.drop_near(named).collect()} >= {"d1", "d4", None} and minhash.drop_near(named).where("doc_id = 'd5'").isEmpty()


def test_overlaps_of_blocks():
    r = np.random.default_rng(3)
    a, b = ([np.unique(r.integers(0, 40, r.integers(0, 20))) for _ in range(n)] for n in (90, 70))
    assert minhash.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


# ---- mixing


def test_mixing_gives_back_every_text(spark, odd, empty, clashing, prose):
    rows = [(i, prose(i, 30 + 17 * i), "en", f"s{i % 3}", 1) for i in range(12)]
    docs = odd(rows)
    out = mixing.mix(docs, with_schedule=True, block_tokens=64).collect()
    assert [r["slot"] for r in out] and {r["source"] for r in out} >= {"s0", "s1", "s2"}
    for k, text, *_ in rows:
        first = sorted({(r["start_token"], r["text"]) for r in out if r["doc_id"] == k and r["epoch"] == 0})
        assert "".join(t for _, t in first) == text
    served = {}
    for s in sorted({(r["slot"], r["source"], r["block"], r["epoch"]) for r in out}):
        served.setdefault(s[1], []).append((s[3], s[2]))
    assert all(v == sorted(v) for v in served.values())
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(clashing(odd(rows)), block_tokens=64).columns == clashing(odd(rows)).columns
    assert {r["source"] for r in mixing.mix(docs, weights={"s1": 1.0}).collect()} == {"s1"}


def test_a_source_of_a_few_tokens_is_served(spark):
    sizes = {"a": 81842, "b": 2310089, "c": 3, "d": 15927}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id bigint, text string, source string")
    raw = {s: n**mixing.ALPHA for s, n in sizes.items()}
    cuts = np.cumsum([max(1, int(1e6 * x / sum(raw.values()))) for x in raw.values()])
    served = np.searchsorted(cuts, mixing.points(0, 1 << 20, int(cuts[-1])), side="right")
    end = max(np.flatnonzero(served == i)[-(-n // mixing.BLOCK) - 1] for i, n in enumerate(sizes.values()))
    got = {(r["slot"], r["source"]) for r in mixing.schedule(docs).collect()}
    assert got == {(i, "abcd"[s]) for i, s in enumerate(served[: end + 1].tolist())}
    blocks = {s: set() for s in sizes}
    for r in mixing.schedule(docs).select("source", "block").distinct().collect():
        blocks[r["source"]].add(r["block"])
    assert {s: len(b) for s, b in blocks.items()} == {s: -(-n // mixing.BLOCK) for s, n in sizes.items()}


def test_mixing_sql_serves_light_sources(spark):
    import duckdb

    sizes = {"a": 81842, "b": 410089, "c": 3, "d": 15927}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.execute(f"SELECT slot, source, epoch, block, doc_id, start_token, end_token FROM ({mixing.ORACLE})").fetchall()
    assert sorted(want) == sorted(map(tuple, mixing.schedule(docs).collect())) and "c" in {r[1] for r in want}


def test_mixing_of_repeated_keys_long_texts_and_many_epochs(spark, odd, prose, monkeypatch):
    monkeypatch.setattr(mixing, "LIST_BLOCKS", 2)
    monkeypatch.setattr(mixing, "LIST_EPOCHS", 1)
    long = prose(1, 40_000)
    rows = [(1, "one two three", "en", "s", 1), (1, "one two", "en", "s", 1), (2, long, "en", "t", 1), (3, prose(2, 30), "en", "u", 1)]
    out = mixing.mix(odd(rows), with_schedule=True, in_order=True, block_tokens=64, weights={"s": 1.0, "t": 1.0, "u": 40.0}).collect()
    assert "".join(t for _, t in sorted({(r["start_token"], r["text"]) for r in out if r["doc_id"] == 2 and r["epoch"] == 0})) == long
    assert {r["text"] for r in out if r["doc_id"] == 1} == {"one two three", "one two"}
    assert max(r["epoch"] for r in out if r["source"] == "u") > 100 and [r["slot"] for r in out] == sorted(r["slot"] for r in out)


def test_points_follow_the_weights():
    p = mixing.points(0, 10_000, 1_000_000)
    for hi in (1_000, 250_000, 700_000):
        assert abs((p < hi).mean() - hi / 1e6) < 0.001


# ---- segmentation


def brute_paths(lattice, unit):
    paths = []
    ends = np.cumsum(lattice.own(unit)).tolist()
    own = set(zip([0, *ends], ends, strict=False))

    def go(i, score, ids):
        if i == len(unit):
            paths.append((score, ids))
            return
        for j in range(i + 1, len(unit) + 1):
            if (s := lattice.score.get(unit[i:j])) is not None:
                go(j, score + s - (0 if (i, j) in own else spm.FOREIGN), ids + lattice.piece_ids(unit[i:j]))
        if unit[i] not in lattice.score:
            go(i + 1, score + lattice.unknown, ids + lattice.piece_ids(unit[i]))

    go(0, 0.0, ())
    return sorted(paths, key=lambda p: (-p[0], p[1]))


@pytest.mark.parametrize("text", ["the cats sat", "naïve 漢字 ok", "a", "unbelievable", "\u0001x", "das  Haus\nist", "aaaa aaaa"])
def test_segmentation_against_all_paths(text):
    m = spm.lattice(spm.MODEL)
    whole = [(0.0, ())]
    for unit in m.units.findall(m.normal(text)):
        want = brute_paths(m, unit)
        got = m.nbest(unit, 4)
        assert [round(s, 4) for s, _ in got] == [round(s, 4) for s, _ in want[:4]]
        assert round(m.solve(unit)[1], 4) == round(want[0][0], 4)
        whole = sorted(((s + t, i + j) for s, i in whole for t, j in want[:6]), key=lambda p: -p[0])[:40]
    best = m.encode(text, 3)
    assert [round(s, 4) for s, _ in best] == [round(s, 4) for s, _ in whole[:3]]
    assert all((round(s, 4), tuple(i.tolist())) in {(round(a, 4), b) for a, b in whole} for s, i in best)
    assert m.decode(best[0][1].tolist()) == text and [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)
    assert len({tuple(i.tolist()) for _, i in best}) == len(best) and all(m.decode(i.tolist()) == text for _, i in best)


def test_best_segmentation_is_the_tokenizers(spark):
    m = spm.lattice(spm.MODEL)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "  two  spaces ", "漢字 und 𝄞 \u0001", "x" * 300, "tab\tand\nline", "<s> </s> <unk> <0x41>", "a ▁ b"]
    for text in texts:
        assert m.encode(text, 1)[0][1].tolist() == m.processor.encode(text)
    units = [u for u in m.index if len(u) > 1][:4000]
    who, end, size = m.cuts(units)
    for k, unit in enumerate(units):
        assert m.merged(unit) == size[who == k].tolist() and np.cumsum(size[who == k]).tolist() == end[who == k].tolist()


def test_ties_do_not_make_the_search_longer():
    m = spm.lattice(spm.MODEL)
    for unit in ("▁" + "ab" * 2000, "ha" * 1500):
        got = m.nbest(unit, 5)
        assert len({i for _, i in got}) == 5 and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def test_units_that_come_up_again_are_solved_once(prose, monkeypatch):
    """A full table forgets rare units, not frequent ones, and the segmentations stay the same."""
    texts = [f"the common words of {prose(9000 + i, 3)} number{i}x" for i in range(40)]
    want, small = spm.Lattice().encode_all(texts), spm.Lattice()
    monkeypatch.setattr(spm, "REMEMBER", 30)
    learned = []
    learn = small.learn
    monkeypatch.setattr(small, "learn", lambda units: (learned.extend(units), learn(units))[1])
    got = [small.encode_all(texts[k : k + 4])[n] for k in range(0, 40, 4) for n in range(4)]
    assert [[(s, i.tolist()) for s, i in x] for x in got] == [[(s, i.tolist()) for s, i in x] for x in want]
    assert learned.count("▁common") == 1 and len(small.index) < 60


def test_encode_and_decode(spark, odd, empty, clashing, prose):
    docs = clashing(odd([(1, prose(1, 4000), "en", "s", 1)]))
    out = spm.decode(spm.encode(docs), "_ids")
    for r in out.collect():
        assert r["decoded"] == r["text"] and (r["exact"] is None) == (r["text"] is None)
    assert spm.encode(empty).count() == 0 and docs.columns == spm.encode(docs).columns[: len(docs.columns)]


# ---- personal data


def test_crf_held_out():
    m = pii.model()
    f, doc, y = pii.gold(pii.labelled_table(300, seed=77))
    p = m.decode(m.emissions(m.ids(f), doc), doc)
    assert (p == y).mean() > 0.99 and (p == y)[y > 0].mean() > 0.95


def test_viterbi_against_brute_force():
    m, r = pii.model(), np.random.default_rng(2)
    n, k = 60, len(pii.LABELS)
    doc = np.sort(r.integers(0, 14, n))
    e = r.normal(0, 3, (n, k)).astype(np.float32)
    e[r.random(n) < 0.4, 0] += 12
    got = m.decode(e, doc)
    for d in np.unique(doc):
        rows = np.flatnonzero(doc == d)
        v, back = m.first + e[rows[0]], []
        for i in rows[1:]:
            s = v[:, None] + m.transition
            back.append(s.argmax(0))
            v = s.max(0) + e[i]
        y = [int(v.argmax())]
        for b in back[::-1]:
            y.append(int(b[y[-1]]))
        assert got[rows].tolist() == y[::-1]


def test_pii_rows(spark, odd, empty, clashing):
    text = "ich bin\nund.34@mail7.example.com na +1 (017) 555-7713 ver ist 97.51.17.173 ok 4929963689861572 und token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" été."
    out = pii.findings(clashing(odd([(1, text, "de", "s", 1), (2, "nur 12 worte und 3.5 mehr", "de", "s", 1)]))).collect()
    assert [r["doc_id"] for r in out] == [1]
    r = out[0]
    assert [f["kind"] for f in r["found"]] == ["EMAIL", "PHONE", "IP", "CARD", "SECRET"] and r["n_found"] == 5
    assert text[r["found"][1]["start"] : r["found"][1]["stop"]] == "+1 (017) 555-7713"
    assert r["text"] == 'ich bin\n[EMAIL] na [PHONE] ver ist [IP] ok [CARD] und token = "[SECRET]" été.'
    assert pii.findings(empty).count() == 0


def test_pii_in_long_texts_and_repeated_rows(spark, odd, prose):
    long = f"{prose(1, 30_000)} mail to anna.b@mail3.example.com now {prose(2, 30_000)}"
    out = pii.findings(odd([(1, long, "en", "s", 1), (1, long, "en", "s", 1)])).collect()
    at = long.index("anna.b@")
    assert [(r["doc_id"], [(f["kind"], f["start"]) for f in r["found"]]) for r in out] == [(1, [("EMAIL", at)])] * 2


def test_crf_gradient_against_differences():
    """Labels that the weights make likelier in training are those whose likelihood grows."""
    table = pii.labelled_table(40, seed=3)
    few = pii.fit(table)
    f, doc, y = pii.gold(table)

    def likelihood(m):
        e, total = m.emissions(m.ids(f), doc).astype(float), 0.0
        for d in range(int(doc.max()) + 1):
            rows = np.flatnonzero(doc == d)
            a = m.first + e[rows[0]]
            gold = a[y[rows[0]]]
            for i, j in zip(rows, rows[1:], strict=False):
                a = np.logaddexp.reduce(a[:, None] + m.transition, axis=0) + e[j]
                gold += m.transition[y[i], y[j]] + e[j, y[j]]
            total += gold - np.logaddexp.reduce(a)
        return total

    zero = pii.Crf(few.known, [np.zeros_like(w) for w in few.emission], np.zeros_like(few.transition), np.zeros_like(few.first))
    assert likelihood(zero) < -500 and likelihood(few) > 0.1 * likelihood(zero)


# ---- quality


def labelled(prose, n=160):
    rows, labels = [], []
    for i in range(1000, 1000 + n):
        good = i % 2
        text = prose(i, 80) if good else " ".join(f"{w}!!" for w in prose(i, 9).split() * 9).upper()
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, good))
    return rows, labels


@pytest.mark.parametrize("kind", ["rules", "gam"])
def test_quality(spark, odd, empty, clashing, prose, kind):
    rows, labels = labelled(prose)
    train, test = rows[:120], rows[120:]
    known = spark.createDataFrame([*labels[:120], (None, 1), (500, None)], "doc_id bigint, quality int")
    f = (lambda d, q: quality_rules.kept_scores(d, q)) if kind == "rules" else (lambda d, q: gam.classify(d, q))
    docs = odd([*train, *test])
    kept = {r["doc_id"] for r in f(docs, known).collect()}
    right = sum((k in kept) == bool(labels[k - 1000][1]) for k, *_ in test)
    assert right >= 0.95 * len(test) and not kept & {90, 91, 92}
    assert f(empty, known).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["doc_id"] for r in f(docs, none).collect()} >= {k for k, *_ in test}
    if kind == "rules":
        out = quality_rules.keep_good(clashing(docs), known)
        assert out.columns == clashing(docs).columns and {r["doc_id"] for r in out.collect()} == kept


MASK = (1 << 64) - 1


def brute_mean(w, text):
    """Sum over the kinds of n-grams of their mean weight, by loops over integers."""

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & MASK
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & MASK
        return x ^ x >> 33

    def word(t):
        p, power = 0x9E3779B97F4A7C15, 1
        h = 0
        for c in t:
            h = h + (c + 1) * power & MASK
            power = power * p & MASK
        return mix(h)

    found, top, bits = [[], [], [], []], 64 - quality_rules.BITS, quality_rules.BITS
    for kind, n in ((0, 3), (1, 4)):
        for i in range(len(text) - n + 1):
            gram = int.from_bytes(text[i : i + n], "little")
            h = gram * 0x9E3779B1 & 0xFFFFFFFF
            h ^= (gram >> 15) * (0x85EBCA77 + n) & 0xFFFFFFFF
            h = h * 0xC2B2AE3D & 0xFFFFFFFF
            found[kind].append(h >> 32 - bits)
    words = [word(t) for t in text.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if t]
    found[2] = [mix(h + 1 & MASK) >> top for h in words]
    found[3] = [(1 if a == b else mix(a * 0x9DDFEA08EB382D69 + b & MASK)) >> top for a, b in zip(words, words[1:], strict=False)]
    return sum(sum(float(w[i]) for i in f) / (len(f) + s) for f, s in zip(found, quality_rules.SHRINK.tolist(), strict=True))


def test_rules_score_like_plain_loops(prose, monkeypatch):
    w = np.random.default_rng(0).normal(size=1 << quality_rules.BITS).astype(np.float32)
    texts = [prose(i, n).encode() for i, n in enumerate((1, 2, 3, 40, 900))] + [b"", b" ", b"ab", b"same same same", "é ü\n\tx".encode(), b"y" * 5000, prose(9, 60).encode().replace(b" ", b"   \n")]
    want = [brute_mean(w, t) for t in texts]
    got, inked = quality_rules.means(w, texts)
    assert np.allclose(got, want, atol=1e-9) and inked.tolist() == [bool(t.strip()) for t in texts]
    # very long texts go by parts, with the same n-grams
    monkeypatch.setattr(quality_rules, "PART", 150)
    monkeypatch.setattr(quality_rules.textkit, "chunks", lambda t, limit=0: ((i, i + 1) for i in range(len(t))))
    assert np.allclose(quality_rules.means(w, texts)[0], want, atol=1e-9)


def test_rules_train_on_a_sample_that_all_tasks_look_for(spark, prose):
    rows, labels = labelled(prose)
    docs = spark.createDataFrame(rows * 3, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(6)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    sample = quality_rules.common.labelled_sample(docs, known, 1000)
    assert sample.count() == len(labels)  # repeated rows count once
    plan = sample.repartition(1)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Coalesce 1" not in plan and "hashpartitioning" in plan.split("SinglePartition")[1]  # the sample comes to one task, not the scan


def test_gam_scores_like_plain_loops(prose):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, len(gam.STATISTICS)))
    y = (x[:, 1] + x[:, 4] * x[:, 6] + r.normal(0, 0.3, 600) > 0).astype(int)
    m = gam.fit(x, y, np.arange(600) % 5 == 0)
    x[0, 1] = m["edges"][1][3]  # on a bin's edge
    for row, got in zip(x[:50], gam.log_odds(m, x[:50]), strict=True):
        z = m["bias"]
        for k, table in enumerate(m["tables"]):
            z += table[sum(1 for e in m["edges"][k] if e <= row[k])]
        for (k, q), table in zip(m["pairs"], m["pair_tables"], strict=True):
            z += table[sum(1 for e in m["pair_edges"][k] if e <= row[k])][sum(1 for e in m["pair_edges"][q] if e <= row[q])]
        assert abs(z - got) < 1e-9


def test_statistics_against_plain_python(prose):
    texts = [prose(1, 60), "a a b\nA1, ü!\n\na a b", "x", f"{prose(2, 20)}\n{prose(3, 9)}", prose(4, 20_000)]
    for text, row in zip(texts, gam.statistics([t.encode() for t in texts]), strict=True):
        raw, got = text.encode(), dict(zip(gam.STATISTICS, row.tolist(), strict=True))
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        size = [len(w) for w in words]
        share = {v: raw.count(bytes([v])) / len(raw) for v in set(raw)}
        want = {
            "bytes": np.log1p(len(raw)), "words": np.log1p(len(words)), "word_mean": np.mean(size), "word_max": np.log1p(max(size)), "word_spread": np.std(size), "short_words": np.mean([n <= 3 for n in size]),
            "new_words": len(set(words)) / len(words), "new_bigrams": len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1), "stutter": sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words),
            "lines": np.log1p(len(lines)), "new_lines": len(set(lines)) / len(lines), "line_mean": np.log1p(np.mean([len(x) for x in lines])), "entropy": -sum(p * np.log(p) for p in share.values()), "digits": sum(c in b"0123456789" for c in raw) / len(raw),
        }
        assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("kind", ["rules", "gam"])
def test_quality_takes_long_texts_and_clashing_columns(spark, odd, clashing, prose, kind):
    rows, labels = labelled(prose)
    long = [(1, prose(1, 60_000), "en", "s", 1), (2, "Z!! " * 40_000, "en", "s", 1)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    f = quality_rules.kept_scores if kind == "rules" else gam.classify
    plain = rows_of(f(odd([*rows, *long]), known))
    assert rows_of(f(clashing(odd([*rows, *long])), known)) == plain and {1, 2} & {r[0] for r in plain} == {1}


def test_gam_finds_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, len(gam.STATISTICS)))
    y = ((x[:, 3] > 0) ^ (x[:, 5] > 0)).astype(int)
    m = gam.fit(x, y, np.arange(2000) % 5 == 0)
    assert (3, 5) in m["pairs"]
    z = gam.log_odds(m, x)
    assert ((z > 0) == y).mean() > 0.9


def test_platt_is_stable_on_separated_classes():
    z = np.concatenate([np.full(50, -40.0), np.full(90, 40.0)])
    a, b = quality_rules.platt(z, (z > 0).astype(int))
    assert 0 < a < 1 and abs(b) < 5


# ---- substring dedup


def test_chains_try_every_predecessor():
    def links(frags):
        return sorted(len(c) - 1 for c in chaining.chains(frags))

    second = [(1200 + 11 * i, 1200 + 11 * i, 10) for i in range(20)]
    assert links(second) == [19] and links([(0, 0, 1000), *second]) == [0, 19]

    def best(frags):
        score = []
        for i, (s, r, w) in enumerate(frags):
            gains = [0.0]
            for j, (a, b, c) in enumerate(frags[:i]):
                x, y = s - a - c, r - b - c
                over = max(0, -x, -y)
                if over < min(chaining.K, w) and max(x, y) <= chaining.MAX_GAP and a < s and b < r:
                    gains.append(score[j] - chaining.GAP_COST * (x + y) - over)
            score.append(w + max(gains))
        return max(score)

    def got(frags, chain):
        total = frags[chain[0]][2]
        for i, j in zip(chain, chain[1:], strict=False):
            (a, b, c), (s, r, w) = frags[i], frags[j]
            total += w - chaining.GAP_COST * (s - a - c + r - b - c) - max(0, a + c - s, b + c - r)
        return total

    r = random.Random(5)
    for n in range(200):
        far = [(0, r.randrange(100), 300)] if n % 2 else []
        frags = sorted({*far, *((330 + r.randrange(400), 330 + r.randrange(400), r.randint(6, 20)) for _ in range(r.randint(1, 40)))})
        assert max(got(frags, c) for c in chaining.chains(frags)) == best(frags)


def test_edits():
    assert chaining.edits(np.array([1, 2, 3, 4]), np.array([1, 3, 4, 5])) == 2
    assert chaining.edits(np.array([1, 2]), np.array([], int)) == 2


@pytest.mark.parametrize(("limit", "slot"), [(1 << 30, 1 << 30), (-1, 40)])
def test_substring_dedup(spark, odd, empty, clashing, prose, limit, slot):
    passage = prose(1000, 70).split()
    fuzzy = [w if i % 11 else "changed" for i, w in enumerate(passage)]
    rows = [(0, f"{prose(1, 40)} {' '.join(passage)} {prose(2, 40)}", "en", "s", 1), (1, f"{prose(3, 90)} {' '.join(passage).upper()}, {prose(4, 10)}", "en", "s", 1), (2, f"{' '.join(fuzzy)} {prose(5, 30)}", "en", "s", 1)]
    rows += [(3, prose(6, 200), "en", "s", 1), (4, " ".join(passage[:30]), "en", "s", 1), (5, "same " * 120, "en", "s", 1), (6, "same " * 80, "en", "s", 1)]
    rows += [(7, prose(6, 200), "en", "s", 1)]
    out = {r["doc_id"]: r for r in chaining.repeated_passages(clashing(odd(rows)), broadcast_limit=limit, slot_limit=slot).collect()}
    assert set(out) == {1, 2, 6, 7}
    assert (out[1]["start_word"], out[1]["end_word"], out[1]["ref_id"], out[1]["ref_start"], out[1]["identity"]) == (90, 160, 0, 40, 1.0)
    assert out[2]["start_word"] <= 1 and out[2]["end_word"] >= 65 and 0.85 < out[2]["identity"] < 0.95
    assert (out[7]["ref_id"], out[7]["n_words"]) == (3, 200)
    assert chaining.repeated_passages(empty).count() == 0


def test_all_shared_runs_are_covered(spark, odd, prose):
    """Every run of 50 words that an earlier document has too is inside a passage; documents without one have none."""
    r, n = random.Random(8), chaining.MIN_WORDS
    passages = [prose(4000 + i, r.randint(40, 160)) for i in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(5000 + i, r.randint(10, 80))]
        for p in r.sample(passages, r.randint(0, 2)):
            parts += [p, prose(6000 + 7 * i + len(parts), r.randint(5, 60))]
        rows.append((i, " ".join(parts), "en", "s", 1))
    rows += [(i + 100, rows[i][1], "en", "s", 1) for i in range(0, 60, 9)]
    seen, want = {}, {}
    for k, text, *_ in rows:
        words = text.split()
        runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        want[k] = {at for i, run in enumerate(runs) if run in seen for at in range(i, i + n)}
        for run in runs:
            seen.setdefault(run, k)
    got = {k: set() for k in want}
    for x in chaining.repeated_passages(odd(rows)).collect():
        got[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
        assert x["ref_id"] < x["doc_id"] and x["n_words"] >= n
    assert all(want[k] <= got[k] for k in want)
    assert all(bool(want[k]) == bool(got[k]) for k in want)
    assert all(len(got[k] - want[k]) <= 12 for k in want)  # ends may take a few equal words more


def test_passages_of_repeated_keys_text_keys_and_long_texts(spark, odd, clashing, prose):
    passage = prose(7000, 80)
    long = f"{prose(7001, 20_000)} {passage} {prose(7002, 20_000)}"
    rows = [(1, f"{prose(7003, 20)} {passage}", "en", "s", 1), (2, long, "en", "s", 1), (2, "short", "en", "s", 1), (3, f"{passage} {passage}", "en", "s", 1)]
    got = {(r["doc_id"], r["ref_id"], r["start_word"], r["end_word"]) for r in chaining.repeated_passages(clashing(odd(rows))).collect()}
    assert (2, 1, 20_000, 20_080) in got and {g[0] for g in got} == {2, 3}
    named = odd(rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {(r["doc_id"], r["ref_id"], r["start_word"], r["end_word"]) for r in chaining.repeated_passages(named).collect()} == {(f"d{a}", f"d{b}", s, e) for a, b, s, e in got}


def test_passages_whose_parts_earlier_documents_have(spark, odd, prose):
    """Every seed of the last document stands first in a document with too short a part of the passage."""
    passage = prose(8000, 125).split()
    rows = [(i, f"{prose(8001 + i, 30)} {' '.join(passage[25 * i : 25 * i + 25])}", "en", "s", 1) for i in range(5)]
    rows += [(9 + i, f"{prose(8020 + i, 30)} {' '.join(passage[25 * i - 12 : 25 * i + 13])}", "en", "s", 1) for i in range(1, 5)]
    fuzzy = " ".join(w if i % 25 else f"changed{i}" for i, w in enumerate(passage))
    rows += [(20, f"{prose(8010, 40)} {' '.join(passage)}", "en", "s", 1), (21, f"{prose(8011, 40)} {fuzzy} {prose(8012, 40)}", "en", "s", 1)]
    (out,) = chaining.repeated_passages(odd(rows)).collect()
    assert (out["doc_id"], out["ref_id"]) == (21, 20) and out["start_word"] <= 41 and out["end_word"] >= 164


def test_passages_among_hot_seeds(spark, odd, prose):
    """Seeds that many documents have are compared by what is about them, and no passage is lost by that."""
    head, more, around = prose(8100, 14), prose(8101, 13), prose(8102, 80).split()
    rows = [(i, f"{prose(8200 + i, 20 + i)} {head} {prose(8300 + i, 60)} {more if i % 3 else ''} {prose(8400 + i, 40)}", "en", "s", 1) for i in range(40)]
    alike = [" ".join(w if i % 6 else f"other{n}x{i}" for i, w in enumerate(around)).split() for n in (0, 1)]
    for n, words in enumerate(alike):  # equal runs of five words, too short for a seed, before and after the head
        rows.append((50 + n, f"{prose(8500 + n, 9)} {' '.join(words[:36])} {head} {' '.join(words[36:])}", "en", "s", 1))
        rows.append((60 + n, f"{prose(8600 + n, 60)} {head} {f'{n}x ' * 20} {more} {prose(8602, 7)} {prose(8603 + n, 30)}", "en", "s", 1))
        rows.append((70 + n, f"{prose(8700 + n, 30)} {head} {prose(8702, 60)} {more}", "en", "s", 1))
    rows += [(80, rows[3][1], "en", "s", 1), (81, f"{head} {head} {head} {head}", "en", "s", 1), (82, f"x {head} {head} {head} {head} y", "en", "s", 1)]
    full, few = ({tuple(r) for r in chaining.repeated_passages(odd(rows), hot_limit=hot).collect()} for hot in (1 << 30, 5))
    assert few == full and {51, 71, 80, 82} <= {r[0] for r in full}


def test_few_matches_of_hot_seeds(prose):
    """Texts that share a phrase among other seeds don't meet; runs of one word meet as stretches, not word by word."""

    def matches(texts):
        g, _, _ = chaining.seeds(texts)
        u, count = np.unique(g, return_counts=True)
        g, doc, at, many, *place = chaining.places(texts, None, u[count > 64])
        assert many.any()
        return sum(len(b["k"]) for b in chaining.hot_matches(g[many], doc[many], at[many].astype(np.int32), *place, 35))

    head, n = prose(8100, 14), 200
    assert matches([f"{prose(9000 + i, 60)} {head} {prose(9500 + i, 60)}".encode() for i in range(n)]) < n * n // 4
    assert matches([f"{prose(9000 + i, 60)} {'on ' * 90} {prose(9500 + i, 60)}".encode() for i in range(n)]) < n * n


@pytest.mark.parametrize("together", [False, True])
def test_seeds_that_earlier_documents_have_singly(spark, odd, prose, together):
    passage = prose(2000, 120).split()
    runs = [passage[i : i + 11] for i in range(0, 120, 12)]
    singly = [f"{prose(3000 + i, 30)} {' '.join(run)}" for i, run in enumerate(runs)][::-1]
    rows = [(i, text, "en", "s", 1) for i, text in enumerate([" ".join(singly)] if together else singly)]
    fuzzy = " ".join(w if i % 12 < 11 else f"changed{i}" for i, w in enumerate(passage))
    rows += [(20, f"{prose(1, 40)} {' '.join(passage)}", "en", "s", 1), (21, f"{prose(2, 40)} {fuzzy} {prose(4, 40)}", "en", "s", 1)]
    (out,) = chaining.repeated_passages(odd(rows)).collect()
    assert (out["doc_id"], out["ref_id"]) == (21, 20) and out["start_word"] <= 52 and out["end_word"] >= 147


def test_chains_that_cannot_be_passages_are_left_out(spark, prose):
    """A chain of 12 words that stays alone isn't aligned; one whose ends go on is, also over a gap or at a text's end."""
    phrase = prose(1, 12)
    texts = [f"{prose(2, 60)} {phrase} {prose(3, 60)}", f"{prose(4, 60)} {phrase} {prose(5, 60)}", prose(6, 50), f"{prose(7, 9)} {prose(6, 50)}"]
    some = spark.createDataFrame(list(enumerate(texts)), "k bigint, x string")
    chain = lambda *frags: np.array(frags, np.int32).tobytes()
    rows = [(1, 0, 0, chain((60, 60, 12))), (3, 2, 0, chain((15, 6, 12))), (3, 2, 1, chain((9, 0, 12), (30, 21, 12))), (1, 2, 0, chain((0, 0, 12)))]
    found = spark.createDataFrame(rows, "k bigint, ref bigint, c int, frags binary")
    assert {tuple(r)[:3] for r in chaining.plausible(found, some, 35).collect()} == {(3, 2, 0), (3, 2, 1)}


def test_ranges_of_many_chains():
    chains = [np.array(x, np.int32) for x in ([(60, 50, 12)], [(5, 90, 12), (40, 120, 20), (58, 170, 7)], [(0, 0, 30)])]
    first = np.cumsum([0, *map(len, chains)])
    for side in (0, 1):
        got, at = chaining._asked(np.concatenate(chains), first, side)
        assert [x.tolist() for x in np.split(got, at[1:-1])] == [chaining.windows(c)[side].tolist() for c in chains]

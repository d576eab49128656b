import numpy as np
import pytest

from loomset.llm import chat, permutation


def test_neighbours_recall_and_odd_rows(spark):
    x = np.random.default_rng(0).normal(size=(400, 16))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(None, x[0].tolist(), 1), (900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0], 1), (904, [float("nan")] * 16, 1), (905, [None] * 16, 1), rows[3]]
    df = spark.createDataFrame([(*r, 5, 6, 7) for r in [*rows, *bad]], "vec_id bigint, embedding array<double>, k int, v int, posts int, asks int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :10]
    for block in (permutation.BLOCK, 40):
        out = permutation.neighbours(df, every=1, block=block).toPandas()
        got = out.groupby("vec_id").neighbour_id.apply(set)
        assert set(got.index) == set(range(400)) and (out.groupby("vec_id").size() == 10).all()
        assert np.mean([len(got[i] & set(want[i])) / 10 for i in range(400)]) >= 0.9
        few = permutation.neighbours(df, block=block).toPandas()
        assert set(few.vec_id) == set(range(0, 400, 20)) and np.mean([len(set(g.neighbour_id) & set(want[i])) / 10 for i, g in few.groupby("vec_id")]) >= 0.9
    assert permutation.neighbours(df.where("false")).count() == 0
    two = permutation.neighbours(df.where("vec_id in (1, 2)"), every=1).collect()
    assert {(r["vec_id"], r["neighbour_id"], r["rank"]) for r in two} == {(1, 2, 1), (2, 1, 1)}


def test_each_dimension_is_searched(spark):
    x = np.random.default_rng(3).normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(100, [1.0] * 17), (200, [1.0, 0.0]), (201, [1.0, 0.1]), (202, [0.0, 1.0])]
    schema = "vec_id bigint, embedding array<double>"
    alone = permutation.neighbours(spark.createDataFrame(rows, schema), every=1).collect()
    got = permutation.neighbours(spark.createDataFrame([*rows, *odd], schema), every=1).collect()
    assert len(alone) == 600 and sorted(r for r in got if r["vec_id"] < 100) == sorted(alone)
    assert {(r["vec_id"], r["neighbour_id"], r["rank"]) for r in got if r["vec_id"] >= 100} == {(200, 201, 1), (200, 202, 2), (201, 200, 1), (201, 202, 2), (202, 201, 1), (202, 200, 2)}


def test_recall_on_tight_clusters(spark):
    r = np.random.default_rng(7)
    centre = r.normal(size=64)
    centre /= np.linalg.norm(centre)
    random = r.normal(size=(750, 64))
    for x in (centre + 0.05 * r.normal(size=(1500, 64)), centre + 0.02 * r.normal(size=(1500, 64)), np.vstack([centre + 0.05 * r.normal(size=(750, 64)), random])):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
        np.fill_diagonal(s, -9)
        want = np.argsort(-s, axis=1)[:, :10]
        out = permutation.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), every=3).toPandas()
        got = out.groupby("vec_id").neighbour_id.apply(set)
        assert set(got.index) == set(range(0, len(x), 3))
        recall = [len(got[i] & set(want[i])) / 10 for i in got.index]
        assert np.mean(recall) >= 0.95 and np.mean(recall[:250]) >= 0.95


def test_footrule_against_brute_force():
    r = np.random.default_rng(1)
    p, listed = 12, 6
    lists = np.stack([r.permutation(p)[:listed] for _ in range(20)])
    ranks = np.full((p, 20), listed, np.uint8)
    ranks[lists, np.arange(20)[:, None]] = np.arange(listed)
    got = np.stack([permutation.footrule(ranks, q) for q in lists]).astype(int)
    full = ranks.T.astype(int)
    want = np.abs(full[:, None] - full[None]).sum(2)
    assert (np.diff(2 * got - want, axis=1) == 0).all()


def test_only_the_share_in_order_is_reranked():
    x = np.eye(64, dtype=np.float32)[np.zeros(4096, int)]
    x[:, 1] = np.linspace(0, 1, 4096)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, order = np.arange(4096), np.arange(4096)
    best, near, n = permutation.nearest(-1, ids, x, x[0], order, 10, 32)
    assert best.tolist() == list(range(10)) and near[0] == 1 and n == 64
    best, _, n = permutation.nearest(0, ids, x, x[0], order[::-1], 10, 32)  # lists that say the contrary: all are reranked
    assert best.tolist() == list(range(1, 11)) and n == 4096


def test_ties_go_by_key(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(15)], "vec_id bigint, embedding array<float>")
    out = permutation.neighbours(df, k=3, every=1).orderBy("vec_id", "rank").collect()
    assert [r["neighbour_id"] for r in out if r["vec_id"] == 1] == [0, 2, 3]


def test_text_keys(spark):
    x = np.random.default_rng(5).normal(size=(40, 8)).tolist()
    by_number = permutation.neighbours(spark.createDataFrame(list(enumerate(x)), "vec_id bigint, embedding array<double>"), every=4).collect()
    by_name = permutation.neighbours(spark.createDataFrame([(f"v{i:02d}", v) for i, v in enumerate(x)], "vec_id string, embedding array<double>"), every=4).collect()
    assert sorted((f"v{a:02d}", f"v{b:02d}", s, r) for a, b, s, r in by_number) == sorted(map(tuple, by_name)) and len(by_name) == 100


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (1, 2, None, "what"), (1, 3, "assistant", None), (2, 0, "user", "alone"), (None, 0, "assistant", "lost"), (3, None, "assistant", "first"), (3, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 5, 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, ms int, prompt int")
    out = chat.expand_turns(df).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["turn"], r["n_context"]) for r in out] == [(1, 1, 1), (1, 3, 3), (3, None, 0), (3, 0, 1)]
    assert out[0]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n" and out[0]["reply"] == "yo<|im_end|>"
    for r in out:
        assert (r["prompt"] + r["reply"])[r["train_start"] : r["train_end"]] == r["reply"]
    assert chat.expand_turns(df.where("false")).count() == 0


def test_pipeline_without_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, src)
        out.write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == docs.columns
        seen.append(new.count())
        docs = new
    assert seen[0] > seen[2] > 0 and seen[3] >= seen[2] and seen[4] == seen[3]
    assert sorted(map(str, corpus_pipeline.run(spark, src).select("doc_id", "ids").collect())) == sorted(map(str, docs.select("doc_id", "ids").collect()))
    assert docs.where("not exact").count() == 0
    empty = spark.read.parquet(f"{src}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, src).count() == 0
    assert docs.where("part is null or row is null").isEmpty()


def test_pipeline_stages_with_odd_rows(spark, odd, clashing, prose):
    """Nulls, blanks, repeated rows, a very long text and clashing names through each stage; columns stay but in the last."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    src = "/root/testdata/sf0.001"
    good = spark.read.parquet(f"{src}/documents.parquet").join(spark.read.parquet(f"{src}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").first()["text"]
    long = " ".join(good.split()[i % len(good.split())] + str(i // 97) for i in range(20_000))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, good, "en", "t", 1), (3, long, "en", "t", 1), (None, good, "en", None, 1)]
    docs = clashing(odd(rows))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, src)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.where("length(text) > 100").collect()) == sorted(["1", "1", "2", "None"] + ["3"] * kept.where("doc_id = 3").count())
    assert kept.where("text is null or trim(text) = ''").isEmpty()
    lines = stages["line dedup"](spark, docs, src)
    assert lines.columns == docs.columns and sorted(str(r["doc_id"]) for r in lines.select("doc_id").collect()) == sorted(["None", "None", "1", "1", "3", "92", "93", "93"])
    near = stages["near dedup"](spark, docs, src)
    assert near.columns == docs.columns and sorted(str(r["doc_id"]) for r in near.select("doc_id").collect()) == sorted(["None", "None", "1", "1", "3", "90", "91", "92", "93", "93"])
    mixed = stages["source mixing"](spark, docs, src)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.select("doc_id").collect()} == {1, 2, 3, 93}
    out = stages["sentencepiece"](spark, docs, src)
    assert out.count() == docs.count() and out.where("exact").count() == docs.where("text is not null").count() and out.where("ids is null").count() == 1


def test_queries_match_sql(spark):
    import parity
    from loomset.llm import queries

    for name in queries.ORACLES:
        assert parity.differences(spark, name, f"{parity.DATA}/sf0.001") == "", name

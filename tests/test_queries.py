"""Every query against its SQL, plans that must stay as they are, and streams against their batch results."""

import math

import numpy as np
import parity
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from loomset.operators import frames, knn, relational, selection
from loomset.plans import catalogue, roundtrips
from loomset.streaming import events

SF = f"{parity.DATA}/sf0.001"


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLES])
def test_same_as_sql(spark, name):
    assert parity.differences(spark, name, SF) == ""


@pytest.mark.parametrize("name", ["q_column_major_items", "q_idx_items", "q_matrix_items", "q_npy_items", "q_npz_items"])
def test_items_are_their_ids_whatever_the_order_of_rows(spark, monkeypatch, name):
    """Each time the table is read its rows come in another order, as they do from a shuffle."""

    def mixed(batches):
        for b in batches:
            yield b.take(pa.array(np.random.default_rng().permutation(b.num_rows)))

    def table(spark, sf, name):
        df = catalogue.table(spark, sf, name)
        return df.mapInArrow(mixed, df.schema)

    monkeypatch.setattr(roundtrips, "table", table)
    assert parity.differences(spark, name, SF) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(catalogue.QUERIES["q_filter_expr"](spark, SF))
    assert "PushedFilters: [IsNotNull" in p and "l_extendedprice" not in p.split("ReadSchema")[1].split("\n")[0]
    assert "Exchange" not in plan(catalogue.QUERIES["q_slice_step"](spark, SF)).split("== Physical Plan ==")[1]


def test_positions_are_dense(spark):
    d = selection.with_positions(spark.range(1000).selectExpr("id % 7 as a", "id"), "a", "id")
    assert [r[0] for r in d.orderBy("a", "id").select("__pos").collect()] == list(range(1000))
    assert selection.with_positions(spark.range(0), "id").count() == 0


def test_spearman(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (None, 1.0), (float("inf"), 2.0), (5.0, 5.0)]
    r = relational.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert r["n"] == 5 and math.isclose(r["rho"], 0.8)
    assert math.isclose(relational.spearman_p(0.8, 5), 0.1040880387, rel_tol=1e-6)
    assert relational.spearman(spark.createDataFrame(rows[:2], "x double, y double"), "x", "y").first()["rho"] is None


def test_windows_need_whole_spans(spark):
    n = spark.createDataFrame([(0, 5), (1, 2)], "g int, n int")
    assert [(r["g"], r["start"]) for r in frames.plan_windows(n, "g", 3, hop=2).collect()] == [(0, 0), (0, 2)]
    assert [(r["g"], r["start"]) for r in frames.plan_windows(n, "g", 2, skip=3).collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        frames.plan_windows(n, "g", 0)


def test_neighbours_against_all_pairs(spark):
    """Equal vectors, a zero vector, repeated and null keys, rows without vector; blocks of one task and of several."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(150, 6)), r.integers(-1, 2, (60, 6)), np.zeros((1, 6))]).astype(np.float32)
    ids = [*range(200), 199, *range(200, 210)]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    table = spark.createDataFrame([*rows, (None, [1.0] * 6), (300, None)], "vec_id bigint, embedding array<float>").repartition(3)
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-12)
    s = (unit @ unit.T).round(6)
    want = set()
    for key in set(ids):
        near = sorted((-s[a, b], ids[b]) for a in range(len(ids)) for b in range(len(ids)) if ids[a] == key and ids[b] != key)
        want |= {(key, b, rank) for rank, (_, b) in enumerate(near[:7], 1)}
    for block in (None, 50):
        assert {tuple(q) for q in knn.neighbours(table, "vec_id", "embedding", 7, block).collect()} == want
    assert knn.neighbours(table.limit(0), "vec_id", "embedding").count() == 0


def test_few_pairs_have_exact_cosines():
    r = np.random.default_rng(6)
    x = r.normal(size=(6000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, taken = knn.Nearest(np.arange(3000), x[:3000], 10), []
    take = near._take
    near._take = lambda q, s, who: (taken.append(len(q)), take(q, s, who))
    for a in range(0, 6000, 1000):
        near.meet(np.arange(a, a + 1000), x[a : a + 1000])
    assert sum(taken) < 3000 * 6000 / 100
    assert (near.who[:, 0] == ((x[:3000] @ x.T).round(6) - 9 * np.eye(3000, 6000)).argmax(1)).all()


def test_rank_me(spark):
    eye = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "v array<double>")
    assert math.isclose(knn.rank_me(eye, "v"), 2, rel_tol=1e-3)


@pytest.mark.parametrize("kind", ["tumbling", "support"])
def test_streams(spark, tmp_path, kind):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(3).write.parquet(src)
    if kind == "tumbling":
        q = events.tumbling(events.follow(spark, src, e.schema, 1), late="3650 days").writeStream.format("memory").queryName("tumbling_out").outputMode("complete")
        q.option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
        got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("tumbling_out").collect()}
        want = {(r["start"], r["event_type"]): r["n"] for r in events.tumbling(e).collect()}
        assert got == want
    else:
        v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label")
        v.write.parquet(str(tmp_path / "v"))
        q = events.support_queue(events.follow(spark, str(tmp_path / "v"), v.schema), 5).writeStream.format("memory").queryName("support_out").outputMode("update")
        q.option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
        rows = spark.table("support_out").collect()
        assert sum(r["n"] for r in rows) == v.count() and all(len(r["held"]) == 5 for r in rows)

"""Samplers, formats, video policy, codecs, frame tables, fetched files, lazy views, and what reports and joins refuse."""

import hashlib
import http.server
import math
import threading
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset import features, storage
from loomset.dataset import Dataset
from loomset.features import Features, Image, Value, Video, VideoDecode
from loomset.functions import vision
from loomset.operators import knn, ordering, relational, selection
from loomset.sources import fetch, sinks


@pytest.fixture(scope="module")
def tiny(spark):
    return Dataset.from_rows(spark, Features({"x": Value("int32"), "image": Image()}), [{"x": i, "image": np.full((4, 4, 3), 10 * i, np.uint8)} for i in range(10)])


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_filters_are_lazy_and_reach_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn(selection.POS, F.col("event_id"))
    view = Dataset(rows, Features.of(rows.drop(selection.POS).schema)).filter("value > 50").map({"twice": "value * 2"}).remove_columns("props")
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value" in plan(view.rows) and "Exchange" not in plan(view.rows)
    assert [r["event_id"] for r in view.select([2, 0])] == [r["event_id"] for r in rows.where("value > 50").orderBy("event_id").collect()][2::-2]


def test_permutations_are_lazy_and_dense(spark):
    d = spark.range(5000).withColumn("x", F.lit("wide"))
    view = selection.shuffled(d, 3, "id")
    assert "ExistingRDD" not in plan(view)  # no checkpoint of the rows
    rows = view.orderBy(selection.POS).collect()
    assert [r[selection.POS] for r in rows] == list(range(5000))
    assert [r["id"] for r in rows] == sorted(range(5000), key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
    assert selection.shuffled(spark.range(0), 3, "id").count() == 0


def test_samplers(tiny):
    orders = {k: [r["x"] for r in tiny.as_iterable(tiny.make_sampler(k, seed=1, shard_rows=4, buffer=3))] for k in ordering.KINDS}
    assert orders["sequential"] == list(range(10)) and all(sorted(o) == list(range(10)) for o in orders.values())
    shards = [x // 4 for x in orders["shard_shuffle"]]
    assert len([1 for a, b in zip(shards, shards[1:], strict=False) if a != b]) == 2
    assert [x // 3 for x in orders["buffer"]] == sorted(x // 3 for x in range(10))
    it = tiny.as_iterable(tiny.make_sampler("random", seed=1))
    first = [r["x"] for r in it]
    it.set_epoch(1)
    assert first != [r["x"] for r in it] and sorted(first) == list(range(10))
    parts = [[r["x"] for r in tiny.as_iterable(tiny.make_sampler("random", shard_rows=4), worker=w, workers=3)] for w in range(3)]
    assert sorted(sum(parts, [])) == list(range(10))
    with pytest.raises(ValueError, match="unknown sampler"):
        tiny.make_sampler("alphabetical")
    with pytest.raises(ValueError, match="out of range"):
        tiny.as_iterable(worker=2, workers=2)


def test_formats(tiny):
    assert tiny[3]["image"].shape == (4, 4, 3) and tiny[3]["image"][0, 0, 0] == 30
    assert tiny.with_format("raw")[3]["image"][:4] == b"\x89PNG" and tiny.set_decode(False)[3]["image"][:4] == b"\x89PNG"
    x = tiny.with_format("channels")[3]["image"]
    assert x.shape == (3, 4, 4) and x.dtype == np.float32 and math.isclose(x[0, 0, 0], 30 / 255, rel_tol=1e-6)
    assert [t.num_rows for t in tiny.with_format("arrow").iter_batches(4)] == [4, 4, 2] and tiny.with_format("pandas").iter_batches(4).__next__().x.tolist() == [0, 1, 2, 3]
    assert next(iter(tiny.with_format("arrow"))).to_pylist()[0]["x"] == 0
    with pytest.raises(ValueError):
        tiny.with_format("csv")


def test_map_infers_its_schema(tiny, spark):
    got = tiny.map(lambda r: {"x": r["x"] + 1, "odd": r["x"] % 2 == 1, "half": r["x"] / 2, "name": str(r["x"]), "list": [r["x"]]})
    types = {f.name: f.dataType.simpleString() for f in got.rows.schema.fields}
    assert types["x"] == "int" and types["odd"] == "boolean" and types["half"] == "double" and types["name"] == "string" and types["list"] == "array<bigint>"
    assert [r["odd"] for r in got][:3] == [False, True, False]
    with pytest.raises(ValueError, match="empty"):
        Dataset.from_rows(spark, Features({"x": Value("int32")}), []).map(lambda r: {"y": 1})


def test_video_policy(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.mp4").write_bytes(bytes([i]))
    ds = Dataset.from_rows(spark, Features({"video": Video("path"), "label": Value("int32")}), [{"video": str(tmp_path / f"{i}.mp4"), "label": i} for i in range(2)])
    assert ds[1]["video"]["media_type"] == "video/mp4"

    def decode(ref, policy, *, row, sample_index):
        return np.full((7, 6, 6, 3), 10 * row["label"], np.uint8) + np.arange(7, dtype=np.uint8)[:, None, None, None]

    out = ds.set_video_decode(num_frames=3, sampling="uniform", height=2, width=2, layout="TCHW", scale=True, decode_fn=decode)[1]["video"]
    assert out.shape == (3, 3, 2, 2) and np.allclose(out[:, 0, 0, 0] * 255, [10, 13, 16])
    assert VideoDecode(num_frames=3, sampling="center", stride=2, decode_fn=decode).indices(7).tolist() == [1, 3, 5]
    assert VideoDecode(num_frames=4, sampling="start", start=5, decode_fn=decode).indices(7).tolist() == [5, 6, 6, 6]
    assert VideoDecode(decode_fn=lambda *a, **k: 1 / 0, on_error="none").frames({}, {}, 0) is None
    for wrong in ({"sampling": "often"}, {"num_frames": 0}, {"height": 3}, {"crop": "center"}, {"layout": "WHAT"}, {"mean": (1.0,)}, {"on_error": "ignore"}, {"stride": 0}):
        with pytest.raises(ValueError):
            VideoDecode(decode_fn=decode, **wrong)
    with pytest.raises(ValueError, match="decode_fn"):
        VideoDecode()
    with pytest.raises(ValueError, match="no column"):
        Dataset.from_rows(spark, Features({"x": Value("int32")}), [{"x": 1}]).set_video_decode(decode_fn=decode)
    assert ds.set_video_decode(decode_fn=decode).set_video_decode(None)[0]["video"]["mode"] == "path"


def test_codecs_can_be_added(spark):
    @features.register_codec
    @dataclass(frozen=True)
    class Celsius:
        digits: int = 1

        def spark_type(self):
            return T.DoubleType()

        def encode(self, value):
            return None if value is None else round(float(value), self.digits)

        def decode(self, raw):
            return None if raw is None else f"{raw} C"

    ds = Dataset.from_rows(spark, Features({"t": Celsius(1)}), [{"t": 20.123}, {"t": None}])
    assert [r["t"] for r in ds] == ["20.1 C", None] and Features.of(ds.rows.select("t").schema)["t"] == Celsius(1)
    with pytest.raises(TypeError):
        features.register_codec(type("Bare", (), {}))


def test_frame_tables(spark, tmp_path):
    frames = spark.createDataFrame([(v, i, bytes([20 * i])) for v, n in ((3, 5), (4, 2)) for i in range(n)], "video_id int, frame_idx int, bytes binary")
    videos = spark.createDataFrame([(3, "a"), (4, "b"), (5, "none")], "video_id int, label string")
    path = str(tmp_path / "t")
    m = storage.write_frames(frames, videos, path)
    assert m["layout"] == "frames" and m["num_rows"] == 7 and storage.open_table(spark, path).count() == 7
    w = storage.open_windows(spark, path, 3, hop=2).orderBy("sample_idx").collect()
    assert [(r["video_id"], r["start_frame"], r["frame_indices"], [f["bytes"][0] for f in r["frames"]], r["label"], r["sample_idx"]) for r in w] == [(3, 0, [0, 1, 2], [0, 20, 40], "a", 0), (3, 2, [2, 3, 4], [40, 60, 80], "a", 1)]
    assert {r["video_id"]: (r["n_frames"], r["start_row"]) for r in spark.read.parquet(f"{path}/videos").collect()} == {3: (5, 0), 4: (2, 5), 5: (0, None)}
    with pytest.raises(FileExistsError):
        storage.write_frames(frames, videos, path)
    rows = str(tmp_path / "r")
    storage.write(videos, rows, order=["video_id"])
    with pytest.raises(ValueError, match="layout"):
        storage.open_windows(spark, rows)


class _Server(http.server.BaseHTTPRequestHandler):
    data, asked = bytes(range(256)) * 40, []

    def do_GET(self):
        self.asked.append((self.path, self.headers.get("Range")))
        if self.path.startswith("/gone"):
            return self.send_error(404)
        start = int(self.headers["Range"].split("=")[1].rstrip("-")) if self.headers.get("Range") else 0
        self.send_response(206 if start else 200)
        self.send_header("Content-Length", str(len(self.data) - start))
        self.end_headers()
        self.wfile.write(self.data[start:])

    def log_message(self, *args):
        pass


def test_fetch(tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at, folder, digest = f"http://127.0.0.1:{server.server_port}", str(tmp_path), "sha256:" + hashlib.sha256(_Server.data).hexdigest()
    asset = fetch.Asset(f"{at}/a/data.tar.gz", checksum=digest, size=len(_Server.data))
    assert asset.file().startswith("data.") and asset.file().endswith(".tar.gz") and len(asset.file()) == len("data..tar.gz") + 10
    (tmp_path / f"{asset.file()}.part").write_bytes(_Server.data[:1000])
    path = fetch.fetch(asset, folder)
    assert open(path, "rb").read() == _Server.data and _Server.asked[-1][1] == "bytes=1000-"
    n = len(_Server.asked)
    assert fetch.fetch(asset, folder) == path and len(_Server.asked) == n  # it is there
    back = fetch.Asset(f"{at}/gone", (f"{at}/other",), digest)
    assert fetch.fetch_all([back, asset, back], folder) == [f"{folder}/{back.file()}", path, f"{folder}/{back.file()}"]
    with pytest.raises(OSError, match="checksum"):
        fetch.fetch(fetch.Asset(f"{at}/bad", checksum="md5:00"), folder)
    assert not (tmp_path / fetch.Asset(f"{at}/bad").file()).exists()
    (tmp_path / "local.bin").write_bytes(b"abc")
    assert open(fetch.fetch(fetch.Asset(f"file://{tmp_path}/local.bin", name="copy.bin"), folder), "rb").read() == b"abc"
    server.shutdown()


def test_a_lock_is_held_by_one(tmp_path):
    order = []

    def work(i):
        with fetch.locked(str(tmp_path / "x")):
            order.append(("in", i))
            threading.Event().wait(0.05)
            order.append(("out", i))

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert all(order[k][1] == order[k + 1][1] for k in range(0, 8, 2))


def test_reports_refuse_long_results(spark, tmp_path):
    with pytest.raises(ValueError, match="more than 5"):
        sinks.latex(spark.range(9), limit=5)
    with pytest.raises(ValueError):
        sinks.csv_report(spark.range(9), str(tmp_path / "x.csv"), limit=5)
    assert sinks.csv_report(spark.range(3), str(tmp_path / "x.csv")) == 3 and (tmp_path / "x.csv").read_text().split() == ["id", "0", "1", "2"]


def test_joins_that_must_match(spark):
    left, right = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    assert relational.join_all(left.where("k = 'a'"), right, "k").collect() == [("a", 1)]
    with pytest.raises(Exception, match="no match for k b"):
        relational.join_all(left, right, "k").collect()


def test_running_base(spark):
    d = spark.createDataFrame([(i * 30_000, i % 5) for i in range(40)], "k bigint, n bigint")
    got = relational.running_base(d, "k", "n", "base").orderBy("k").collect()
    assert [r["base"] for r in got] == [sum(i % 5 for i in range(j)) for j in range(40)]


def test_shards_without_the_driver(spark):
    r = np.random.default_rng(2)
    sizes = r.integers(0, 50, 400).tolist()
    got = storage.shard_of_batches(spark.createDataFrame(list(enumerate(sizes)), "batch bigint, b bigint").repartition(5), 100).orderBy("batch").collect()
    shard, filled = 0, 0
    for row, size in zip(got, sizes, strict=True):
        assert row["shard"] == shard
        filled += size
        if filled >= 100:
            shard, filled = shard + 1, 0


def test_inverted_patch():
    a = np.arange(64, dtype=np.uint8).reshape(8, 8)
    b = vision.inverted_patch(a, 5, 3)
    assert (a != b).sum() == 9 and (a[a != b] + b[a != b] == 255).all() and (b == vision.inverted_patch(a, 5, 3)).all()
    with pytest.raises(ValueError):
        vision.inverted_patch(a, 1, 9)


def test_lidar_against_numpy(spark):
    r = np.random.default_rng(1)
    y = np.repeat(np.arange(4), 30)
    x = r.normal(size=(4, 5))[y] * 3 + r.normal(size=(120, 5))
    got = knn.lidar(spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "v array<double>, c int").repartition(4), "v", "c")
    m = np.stack([x[y == c].mean(0) for c in range(4)])
    within = sum((x[y == c] - m[c]).T @ (x[y == c] - m[c]) for c in range(4)) / 120 + 1e-4 * np.eye(5)
    w, q = np.linalg.eigh(within)
    half = q @ np.diag(w**-0.5) @ q.T
    b = (m - m.mean(0)).T @ (m - m.mean(0)) / 4
    e = np.maximum(np.linalg.eigvalsh(half @ b @ half), 0)
    p = e / e.sum() + 1e-7
    assert math.isclose(got, np.exp(-(p * np.log(p)).sum()), rel_tol=1e-6) and 1 < got < 4

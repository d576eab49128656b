import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset import storage
from loomset.dataset import Dataset, concatenate
from loomset.features import ArrayND, ClassLabel, Features, Image, Sequence, Value, Video, fingerprint

FEATURES = Features({"x": Value("int32"), "label": ClassLabel(("a", "b"))})


@pytest.fixture(scope="module")
def ds(spark):
    return Dataset.from_rows(spark, FEATURES, [{"x": i, "label": "ab"[i % 2]} for i in range(20)])


def test_positions_and_slices(ds):
    assert len(ds) == 20
    assert ds[3] == {"x": 3, "label": 1}
    assert ds[-1]["x"] == 19
    with pytest.raises(IndexError):
        ds[20]
    with pytest.raises(IndexError):
        ds.select([0, 25])
    for s in (slice(2, 9), slice(None, None, 3), slice(15, 2, -4), slice(-5, None), slice(5, 5)):
        assert ds[s]["x"] == list(range(20))[s]
    assert [r["x"] for r in ds[[4, 1, 4]]] == [4, 1, 4]
    assert ds.select([7, 2, 7])[1:3]["x"] == [2, 7]
    assert ds["label"] == [0, 1] * 10


def test_filter_kinds_agree(ds):
    want = [x for x in range(20) if x % 3 == 0]
    assert ds.filter("x % 3 = 0")["x"] == want
    assert ds.filter(F.col("x") % 3 == 0)["x"] == want
    assert ds.filter(lambda r: r["x"] % 3 == 0)["x"] == want
    assert ds.filter(lambda c: [x % 3 == 0 for x in c["x"]], batched=True)["x"] == want
    assert ds.filter("x > 4")[0]["x"] == 5
    assert len(ds.filter("false")) == 0


def test_shuffle_split_sample(ds):
    a, b = ds.shuffle(1)["x"], ds.shuffle(1)["x"]
    assert a == b and sorted(a) == list(range(20)) and a != list(range(20)) and a != ds.shuffle(2)["x"]
    parts = ds.train_test_split(0.25, seed=3)
    train, test = parts["train"]["x"], parts["test"]["x"]
    assert len(train) == 15 and sorted(train + test) == list(range(20))
    assert len(ds.sample(6)["x"]) == 6 and len(set(ds.sample(6)["x"])) == 6


def test_columns(ds):
    d = ds.add_column("y", [float(i) for i in range(20)]).rename_columns({"x": "z", "nothing": "n"})
    assert d.column_names == ["z", "label", "y"] and d[4] == {"z": 4, "label": 0, "y": 4.0}
    assert d.remove_columns(["z"]).column_names == ["label", "y"]
    assert ds.shuffle(1).add_column("k", list(range(20)))["k"] == list(range(20))
    with pytest.raises(ValueError):
        ds.add_column("y", [1])
    with pytest.raises(TypeError):
        ds.add_column("y", [{"a": 1}] * 20)


def test_map(ds):
    assert ds.map({"x": "x * 2", "t": "x > 3"})[5] == {"x": 10, "label": 1, "t": True}
    assert ds.map(lambda r: {"x": r["x"] + 1}, "x int")[5] == {"label": 1, "x": 6}
    assert ds.map(lambda r, i: {"i": i}, "i bigint", with_indices=True, remove_columns=["x"])[5] == {"label": 1, "i": 5}
    twice = ds.map(lambda c: {"v": [v for x in c["x"] for v in (x, -x)]}, "v bigint", batched=True, remove_columns=["x", "label"])
    assert twice["v"] == [v for x in range(20) for v in (x, -x)]
    assert len(ds[0:0].map(lambda r: {"x": r["x"]}, "x int")) == 0


def test_formats(ds):
    with pytest.raises(ValueError):
        ds.with_format("other")
    assert ds.to_arrow().num_rows == 20 and list(ds.to_pandas()["x"]) == list(range(20))
    assert ds.with_transform(lambda r: r["x"] * 10)[2] == 20
    assert [len(b) for b in ds.iter_batches(8)] == [8, 8, 4]


def test_epochs(ds):
    rows = [r["x"] for r in ds.epoch(seed=1, shard_rows=5).orderBy("order").collect()]
    assert sorted(rows) == list(range(20)) and all(len({x // 5 for x in rows[i : i + 5]}) == 1 for i in range(0, 20, 5))
    assert rows != [r["x"] for r in ds.epoch(seed=1, epoch=1, shard_rows=5).orderBy("order").collect()]
    for shard_rows in (5, 100):
        shares = [{r["x"] for r in ds.epoch(shard_rows=shard_rows, worker=w, workers=3).collect()} for w in range(3)]
        assert sum(map(len, shares)) == 20 and set().union(*shares) == set(range(20))


def test_write_open(spark, ds, tmp_path):
    path = str(tmp_path / "t")
    m = ds.shuffle(5).write(path, batch_size=4, shard_bytes=30)
    assert m["num_rows"] == 20 and m["num_shards"] > 1 and sum(m["shard_row_counts"]) == 20
    back = Dataset.open(spark, path, FEATURES)
    assert back["x"] == ds.shuffle(5)["x"] and back.features == FEATURES
    with pytest.raises(ValueError):
        Dataset.open(spark, path, Features({"x": Value("int64"), "label": FEATURES["label"]}))
    with pytest.raises(FileExistsError):
        ds.write(path)
    with pytest.raises(FileNotFoundError):
        storage.manifest_of(str(tmp_path / "none"))
    empty = ds[0:0].write(str(tmp_path / "e"))
    assert empty["num_rows"] == 0 and len(Dataset.open(spark, str(tmp_path / "e"))) == 0


def test_concatenate(ds):
    both = concatenate([ds[:3], ds.remove_columns("label")[3:5]])
    assert both["x"] == [0, 1, 2, 3, 4] and both["label"] == [0, 1, 0, None, None]


def test_features(spark, tmp_path):
    f = Features({"c": ClassLabel(num_classes=3), "s": Sequence(Sequence(Value("float32"))), "a": ArrayND((2, 2, 1), "uint8"), "i": Image(), "v": Video(), "u": Value("uint8")})
    assert Features.of(f.schema()) == f and fingerprint(f.schema()) == fingerprint(Features.of(f.schema()).schema())
    with pytest.raises(KeyError):
        ClassLabel(("a",)).encode("b")
    assert ClassLabel(("a",)).encode(-1) == -1 and ClassLabel(("a", "b")).encode("b") == 1
    with pytest.raises(ValueError):
        Value("complex").spark_type()
    with pytest.raises(TypeError):
        Features({"x": 3})
    a = ArrayND((2, 2, 1), "uint8")
    assert (a.decode(a.encode([[[1], [2]], [[3], [4]]])).ravel() == [1, 2, 3, 4]).all() and a.encode(None) is None
    with pytest.raises(ValueError):
        a.encode([1, 2])
    (tmp_path / "m.webm").write_bytes(b"video")
    v = Video().encode(str(tmp_path / "m.webm"))
    assert v["size"] == 5 and v["media_type"] == "video/webm" and v["bytes"] is None
    with pytest.raises(ValueError):
        Video().encode("x.txt")
    df = spark.createDataFrame([("b",), ("a",)], "n string")
    c = ClassLabel(("a", "b"))
    assert [r[0] for r in df.select(c.encoded(F.col("n"))).collect()] == [1, 0]
    assert [r[0] for r in df.select(c.decoded(c.encoded(F.col("n")))).collect()] == ["b", "a"]
    from loomset.functions.vision import crop, patches, resize, to_layout, unpng

    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (unpng(Image().encode(image)) == image).all()
    assert resize(np.full((4, 6, 3), 7, np.uint8), 2, 3).shape == (2, 3, 3) and (resize(np.full((4, 6, 3), 7, np.uint8), 2, 3) == 7).all()
    assert crop(image, 2, 2)[0, 0, 0] == image[1, 1, 0] and len(patches(image, 2)) == 4
    assert to_layout(image[None], "CTHW", scale=True).shape == (3, 1, 4, 4)

import pytest

from loomset.sources import sinks


def test_append_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.append_checked(a, path)
    sinks.append_checked(a, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        sinks.append_checked(a.withColumnRenamed("b", "c"), path)


def test_assets(tmp_path):
    for name in ("a.MP4", "b.mp4"):
        (tmp_path / name).write_bytes(b"same")
    out = {sinks.stage_asset(str(tmp_path / n), str(tmp_path / "assets")) for n in ("a.MP4", "b.mp4")}
    assert len(out) == 1 and open(out.pop(), "rb").read() == b"same"


def test_frames(spark):
    v = spark.createDataFrame([(3, b"abc"), (5, b""), (7, b"zz")], "video_id int, content binary")
    f = sinks.frame_table(v, lambda d: [bytes([c]) for c in d])
    assert sorted((r["video_id"], r["frame_idx"], bytes(r["bytes"])) for r in f.collect()) == [(3, 0, b"a"), (3, 1, b"b"), (3, 2, b"c"), (7, 0, b"z"), (7, 1, b"z")]
    assert [(r["video_id"], r["n_frames"], r["start_row"]) for r in sinks.frame_manifest(f).orderBy("video_id").collect()] == [(3, 3, 0), (7, 2, 3)]
    assert sinks.frame_table(v, lambda d: 1 / 0, skip_broken=True).count() == 0


def test_latex(spark):
    assert r"a\_b" in sinks.latex(spark.createDataFrame([(1.5, None)], "a_b double, c string"))

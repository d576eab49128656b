import gzip
import io
import struct
import tarfile
import wave
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from loomset.sources import archives, arrow_ipc


def tar_of(files, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files.items():
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("c/1.txt", b"one")
        z.writestr("c/2.txt", b"two")
    (tmp_path / "b.tar.gz").write_bytes(tar_of({"n.tar": tar_of({"x.txt": b"deep"}, "w"), "y.txt": b"flat"}))
    rows = {(r["member"], bytes(r["content"])) for r in archives.archive(spark, str(tmp_path), depth=1).collect()}
    assert rows == {("c/1.txt", b"one"), ("c/2.txt", b"two"), ("n.tar/x.txt", b"deep"), ("y.txt", b"flat")}
    (tmp_path / "c.zip").write_bytes(b"broken")
    assert archives.archive(spark, str(tmp_path), skip_broken=True).count() == 4


def test_arrays(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.gz").write_bytes(gzip.compress(struct.pack(">HBB3I", 0, 8, 3, 2, 3, 4) + a.tobytes()))
    r = archives.array_rows(spark, str(tmp_path / "i"), archives.parse_idx).orderBy("idx").collect()
    assert len(r) == 2 and bytes(r[1]["content"]) == a[1].tobytes() and r[0]["shape"] == [3, 4]
    np.savez(tmp_path / "z.npz", p=a, q=np.arange(3.0))
    got = archives.array_rows(spark, str(tmp_path), archives.parse_npy, "*.npz").groupBy("array").count().collect()
    assert {(x["array"], x["count"]) for x in got} == {("p", 2), ("q", 3)}
    m = struct.pack("<ii3i", 0x1E3D4C54, 2, 2, 3, 1) + np.arange(6, dtype="<i4").tobytes()
    assert (archives.parse_matrix(m) == np.arange(6).reshape(2, 3)).all()
    f = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert (archives.parse_columns(b"".join(x.tobytes(order="F") for x in f), (2, 3)) == f).all()


def test_folder_sound(spark, tmp_path):
    (tmp_path / "dog").mkdir()
    with wave.open(str(tmp_path / "dog" / "s.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[1, -1], [300, -300]], "<i2").tobytes())
    files = archives.folder(spark, str(tmp_path))
    assert files.first()["label"] == "dog"
    s = archives.sounds(files).first()
    assert s["rate"] == 8000 and s["series"] == [[1.0, -1.0], [300.0, -300.0]]


def test_text_formats(spark, tmp_path):
    (tmp_path / "u.ts").write_text("# c\n@problemName T\n@timeStamps false\n@classLabel true a b\n@data\n1,2,?:4,5,6:a\n7,8,9:1,1,1:b\n")
    r = archives.time_series(spark, str(tmp_path / "u.ts")).orderBy("line_no").collect()
    assert [r[0]["label"], r[1]["label"]] == ["a", "b"] and [x["value"] for x in r[0]["series"][0]] == [1.0, 2.0, None] and len(r[0]["series"]) == 2
    (tmp_path / "t.ts").write_text("@timestamps true\n@classlabel true x\n@data\n(0,1.5),(3,2.5):(1,9):x\n")
    t = archives.time_series(spark, str(tmp_path / "t.ts")).first()
    assert [(x["time"], x["value"]) for x in t["series"][0]] == [("0", 1.5), ("3", 2.5)] and t["series"][1][0]["value"] == 9.0 and t["label"] == "x"
    (tmp_path / "a.arff").write_text("% c\n@relation r\n@data\n1, 2, ?, 'dog'\n")
    a = archives.arff(spark, str(tmp_path / "a.arff")).first()
    assert a["values"] == [1.0, 2.0, None] and a["label"] == "dog"
    (tmp_path / "c.csv").write_text("a;b\n1;2\n")
    assert archives.delimited(spark, str(tmp_path / "c.csv")).first().asDict() == {"a": "1", "b": "2"}
    (tmp_path / "w.txt").write_text("1  2 3\n4 5 6\n")
    assert archives.delimited(spark, str(tmp_path / "w.txt"), " ").count() == 2


def test_arrow_shards(spark, tmp_path):
    t = pa.table({"x": pa.array(range(8), pa.uint8()), "y": pa.array(list("abcdefgh"))})
    counts = arrow_ipc.write_shards(t.to_batches(max_chunksize=3), str(tmp_path / "s"), t.schema, shard_bytes=1)
    assert counts == [3, 3, 2]
    arrow_ipc.register(spark)
    df = spark.read.format("arrow_shards").load(str(tmp_path / "s"))
    assert df.rdd.getNumPartitions() == 3 and sorted((r["x"], r["y"]) for r in df.collect()) == list(zip(range(8), "abcdefgh", strict=True))
    with pytest.raises(FileNotFoundError):
        arrow_ipc._paths(str(tmp_path / "none"))

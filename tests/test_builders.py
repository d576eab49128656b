import io
import json
import wave

import numpy as np
import pytest
from test_sources import tar_of

from loomset import builders as B
from loomset.features import ClassLabel, Features, Value
from loomset.functions import collate


def npy(a):
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def test_listed_images_and_cache(spark, tmp_path):
    files = {"b/images.txt": b"1 x/a.jpg\n2 x/b.jpg\n3 y/c.jpg\n", "b/image_class_labels.txt": b"1 1\n2 1\n3 2\n", "b/train_test_split.txt": b"1 1\n2 0\n3 1\n"}
    files |= {f"b/images/{n}": n.encode() for n in ("x/a.jpg", "x/b.jpg", "y/c.jpg")}
    (tmp_path / "a.tgz").write_bytes(tar_of(files))
    b = B.register(B.Builder("Birds", B.images_with(label=ClassLabel(("p", "q"))), {s: B.listed_images(s) for s in ("train", "test")}))
    assets, root = {"archive": str(tmp_path / "a.tgz")}, str(tmp_path / "cache")
    found = B.lookup("birds").build(spark, assets, root)
    assert found["train"]["label"] == [0, 1] and bytes(found["test"][0]["image"]) == b"x/b.jpg"
    again = b.build(spark, {"archive": "/nowhere"}, root, "train")
    assert len(again) == 2 and b.folder(root, "train").endswith(b.cache_key("train"))
    assert B.split_or_fallback(found) is found["test"]
    with pytest.raises(ValueError):
        b.build(spark, assets, root, "other")
    with pytest.raises(KeyError):
        B.lookup("none")


def test_arrays(spark, tmp_path):
    (tmp_path / "c.tar").write_bytes(tar_of({"c/fog.npy": npy(np.arange(16, dtype=np.uint8).reshape(4, 2, 2)), "c/labels.npy": npy(np.array([3, 1, 3, 1]))}, "w"))
    rows = B.levelled_arrays(2)(spark, {"archive": str(tmp_path / "c.tar")}).orderBy("key").collect()
    assert [(r["label"], r["corruption_level"], r["corruption_name"]) for r in rows] == [(3, 1, "fog"), (1, 1, "fog"), (3, 2, "fog"), (1, 2, "fog")]
    np.savez(tmp_path / "f.npz", images=np.zeros((6, 2, 2), np.uint8))
    rows = B.factor_arrays({"hue": 2, "shape": 3})(spark, {"array": str(tmp_path / "f.npz")}).orderBy("key").collect()
    assert [(r["hue"], r["shape"]) for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]


def test_names_and_folders(spark, tmp_path):
    (tmp_path / "p.tar").write_bytes(tar_of({"d/person01100-15+90.jpg": b"j", "d/readme.txt": b""}, "w"))
    r = B.named_files(r"person(\d{2})\d+([+-]\d+)([+-]\d+)", {"person": "int", "tilt": "int", "pan": "int"})(spark, {"archive": str(tmp_path / "p.tar")}).collect()
    assert [(x["person"], x["tilt"], x["pan"]) for x in r] == [(1, -15, 90)]
    for c in ("cat", "dog", "other"):
        (tmp_path / "t" / c).mkdir(parents=True)
        (tmp_path / "t" / c / "1.png").write_bytes(c.encode())
    r = B.class_folders(ClassLabel(("cat", "dog")))(spark, {"folder": str(tmp_path / "t")}).orderBy("key").collect()
    assert [x["label"] for x in r] == [0, 1]


def test_sounds_and_clips(spark, tmp_path):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(10)
        w.writeframes(np.array([5, 6], "<i2").tobytes())
    (tmp_path / "s.tar").write_bytes(tar_of({"a/one.wav": out.getvalue(), "a/two.wav": out.getvalue()}, "w"))
    (tmp_path / "m.csv").write_text("fname,label\none.wav,bark\nnone.wav,bark\n")
    q = B.described_sounds(ClassLabel(("bark",)), defaults={"usage": "", "fsid": ""})
    r = q(spark, {"archive": str(tmp_path / "s.tar"), "table": str(tmp_path / "m.csv")}).collect()
    assert len(r) == 1 and r[0]["series"] == [[5.0], [6.0]] and r[0]["usage"] == ""
    (tmp_path / "v").mkdir()
    for i in (1, 2, 3):
        (tmp_path / "v" / f"{i}.webm").write_bytes(b"v")
    (tmp_path / "l.json").write_text(json.dumps({"labels": {"Holding something": "4"}}))
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "template": "Holding [something]"}, {"id": "2", "template": "Unknown"}]))
    r = B.templated_clips("train")(spark, {"clips": str(tmp_path / "v"), "labels": str(tmp_path / "l.json"), "train": str(tmp_path / "t.json")}).orderBy("key").collect()
    assert [(x["key"], x["template"], x["label"]) for x in r] == [("1", "Holding something", 4), ("2", "Unknown", -1)]


def test_collate():
    out = collate.pad_series([{"series": [1, 2, 3], "label": 0}, {"series": [[4]], "label": 1}])
    assert out["series"].shape == (2, 3, 1) and out["mask"].sum() == 4
    x, m = collate.fit_series(np.array([[1.0], [np.nan], [3.0]]), 4)
    assert x[:, 0].tolist() == [1, 0, 3, 0] and m.tolist() == [True, True, True, False]
    a, b = collate.views([{"v": np.ones(2)}, {"v": np.zeros(2)}], "v", [lambda v: v, lambda v: -v])
    assert a["v"].shape == (2, 2) and (b["v"] == -a["v"]).all()
    assert Features({"x": Value("int8")}).encode({"x": 1, "y": 2}) == {"x": 1}

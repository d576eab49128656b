"""Logical types, kept in the metadata of Spark's fields, and their encoders."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from math import prod

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "loomset"
_PLAIN = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}
#: Types that Spark lacks, widened without loss.
_WIDE = {"uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float16": T.FloatType()}


@dataclass(frozen=True)
class Value:
    dtype: str

    def spark_type(self) -> T.DataType:
        kind = _PLAIN.get(self.dtype) or _WIDE.get(self.dtype)
        if kind is None:
            raise ValueError(f"unknown dtype {self.dtype}")
        return kind

    def encode(self, value):
        return value.item() if isinstance(value, np.generic) else value


@dataclass(frozen=True)
class ClassLabel:
    names: tuple[str, ...] = ()
    num_classes: int | None = None

    def __post_init__(self):
        names = tuple(self.names) or tuple(str(i) for i in range(self.num_classes or 0))
        if self.num_classes is not None and len(names) != self.num_classes:
            raise ValueError("names and num_classes disagree")
        object.__setattr__(self, "names", names)
        object.__setattr__(self, "num_classes", len(names))

    def spark_type(self) -> T.DataType:
        return T.LongType()

    def encode(self, value):
        """Number of a name; numbers pass, -1 (unlabelled) too; an unknown name is a KeyError."""
        if isinstance(value, str):
            if value not in self.names:
                raise KeyError(value)
            return self.names.index(value)
        return None if value is None else int(value)

    def int2str(self, i: int) -> str:
        return self.names[i]

    def encoded(self, name: Column) -> Column:
        """The encoder as a column; an unknown name fails the query."""
        at = F.array_position(F.array(*[F.lit(n) for n in self.names]), name)
        return F.when(name.isNull(), None).when(at == 0, F.raise_error(F.concat(F.lit("unknown class "), name)).cast("long")).otherwise(at - 1)

    def decoded(self, code: Column) -> Column:
        return F.get(F.array(*[F.lit(n) for n in self.names]), code.cast("int"))


@dataclass(frozen=True)
class Sequence:
    feature: object

    def spark_type(self) -> T.DataType:
        return T.ArrayType(self.feature.spark_type())

    def encode(self, value):
        return None if value is None else value.tolist() if isinstance(value, np.ndarray) else list(value)


@dataclass(frozen=True)
class ArrayND:
    """A fixed-shape array as C-order bytes."""

    shape: tuple[int, ...]
    dtype: str = "float32"

    def __post_init__(self):
        if len(self.shape) not in (3, 4):
            raise ValueError("arrays have three or four dimensions")

    def spark_type(self) -> T.DataType:
        return T.BinaryType()

    def encode(self, value):
        if value is None:
            return None
        a = np.asarray(value, self.dtype)
        if a.shape != tuple(self.shape):
            raise ValueError(f"shape {a.shape} is not {self.shape}")
        return np.ascontiguousarray(a).tobytes()

    def decode(self, raw):
        if raw is None:
            return None
        if len(raw) != prod(self.shape) * np.dtype(self.dtype).itemsize:
            raise ValueError("wrong number of bytes")
        return np.frombuffer(raw, self.dtype).reshape(self.shape)


@dataclass(frozen=True)
class Image:
    """Encoded image bytes, kept as they are; decoded to HWC bytes (grey: HW) when rows come out."""

    encode_format: str = "PNG"

    def decode(self, raw):
        """The array of a PNG; bytes of other formats stay bytes, as no decoder of theirs is here."""
        if raw is None or bytes(raw[:8]) != b"\x89PNG\r\n\x1a\n":
            return raw
        from loomset.functions.vision import unpng

        a = unpng(bytes(raw))
        return a[..., 0] if a.shape[2] == 1 else a

    def spark_type(self) -> T.DataType:
        return T.BinaryType()

    def encode(self, value):
        if value is None or isinstance(value, (bytes, bytearray)):
            return value
        if isinstance(value, str):
            with open(value, "rb") as f:
                return f.read()
        if isinstance(value, np.ndarray):
            from loomset.functions.vision import png

            return png(value)
        raise TypeError(f"can't encode {type(value).__name__} as an image")


@dataclass(frozen=True)
class Video:
    """A video by reference or with its bytes."""

    storage: str = "path"
    extensions: tuple[str, ...] = (".mp4", ".avi", ".webm", ".mkv")

    def __post_init__(self):
        if self.storage not in ("path", "bytes", "frames"):
            raise ValueError(f"unknown storage {self.storage}")

    def spark_type(self) -> T.DataType:
        return T.StructType([T.StructField(n, t) for n, t in (("mode", T.StringType()), ("path", T.StringType()), ("bytes", T.BinaryType()), ("extension", T.StringType()), ("media_type", T.StringType()), ("size", T.LongType()), ("checksum", T.StringType()))])

    def encode(self, value):
        if value is None:
            return None
        if self.storage == "frames":
            raise NotImplementedError("frames are rows of their own table")
        raw, ext, path = (bytes(value), self.extensions[0], None) if isinstance(value, (bytes, bytearray)) else (None, "." + str(value).rsplit(".", 1)[-1].lower(), str(value))
        if ext not in self.extensions:
            raise ValueError(f"extension {ext} is not among {self.extensions}")
        if raw is None:
            with open(path, "rb") as f:
                raw = f.read()
        media = {".mp4": "video/mp4", ".avi": "video/x-msvideo", ".webm": "video/webm", ".mkv": "video/x-matroska"}.get(ext, "application/octet-stream")
        keep = raw if self.storage == "bytes" else None
        return {"mode": self.storage, "path": None if keep is not None else path, "bytes": keep, "extension": ext, "media_type": media, "size": len(raw), "checksum": "sha256:" + hashlib.sha256(raw).hexdigest()}


SAMPLING = ("start", "uniform", "center")


@dataclass(frozen=True)
class VideoDecode:
    """How a video's frames are chosen, decoded and laid out when rows come out.

    ``decode_fn(reference, policy, row=, sample_index=)`` gives THWC frames; no video decoder comes with the engine.
    """

    num_frames: int | None = None
    sampling: str = "uniform"
    stride: int = 1
    start: int = 0
    height: int | None = None
    width: int | None = None
    crop: str | None = None
    layout: str = "THWC"
    scale: bool = False
    mean: tuple[float, ...] | None = None
    std: tuple[float, ...] | None = None
    on_error: str = "raise"
    decode_fn: object = None

    def __post_init__(self):
        if self.sampling not in SAMPLING:
            raise ValueError(f"unknown sampling {self.sampling}")
        if self.num_frames is not None and self.num_frames < 1 or self.stride < 1 or self.start < 0:
            raise ValueError("num_frames and stride must be positive, start must not be negative")
        if (self.height is None) != (self.width is None) or self.height is not None and min(self.height, self.width) < 1:
            raise ValueError("height and width go together and must be positive")
        if self.crop not in (None, "center", "random") or self.crop and self.height is None:
            raise ValueError("crop is None, center or random, and needs height and width")
        if self.layout not in ("THWC", "TCHW", "CTHW"):
            raise ValueError(f"unknown layout {self.layout}")
        if self.on_error not in ("raise", "none"):
            raise ValueError(f"unknown on_error {self.on_error}")
        if (self.mean is None) != (self.std is None) or self.mean is not None and len(self.mean) != len(self.std):
            raise ValueError("mean and std go together and must be as long")
        if not callable(self.decode_fn):
            raise ValueError("decode_fn must be a function: no video decoder comes with the engine")

    def indices(self, n: int) -> np.ndarray:
        """Frames taken of ``n``; with more asked for than there are, the last one repeats."""
        if n < 1:
            raise ValueError("no frames")
        if self.num_frames is None:
            return np.arange(min(self.start, n - 1), n, self.stride)
        if self.sampling == "uniform":
            return np.rint(np.linspace(0, n - 1, self.num_frames)).astype(int)
        span = (self.num_frames - 1) * self.stride + 1
        first = self.start if self.sampling == "start" else max(0, (n - span) // 2)
        return np.minimum(first + np.arange(self.num_frames) * self.stride, n - 1)

    def frames(self, reference: dict, row: dict, sample_index: int):
        from loomset.functions import vision

        try:
            got = np.asarray(self.decode_fn(reference, self, row=row, sample_index=sample_index))
            if got.ndim != 4:
                raise ValueError(f"decode_fn gives {got.ndim} dimensions, not THWC")
            got = got[self.indices(len(got))]
            if self.crop:
                got = np.stack([vision.crop(f, self.height, self.width, self.crop, sample_index) for f in got])
            elif self.height is not None:
                got = np.stack([vision.resize(f, self.height, self.width) for f in got])
            if self.mean is not None:
                got = vision.normalise(got.astype(np.float32) / (255 if self.scale else 1), self.mean, self.std).astype(np.float32)
                return vision.to_layout(got, self.layout)
            return vision.to_layout(got, self.layout, self.scale)
        except Exception:
            if self.on_error == "raise":
                raise
            return None


_KINDS = {c.__name__: c for c in (Value, ClassLabel, Sequence, ArrayND, Image, Video)}


def register_codec(kind: type) -> type:
    """Make a logical type known by its class name: a frozen dataclass with ``spark_type``, ``encode`` and, if need be, ``decode``."""
    for needed in ("spark_type", "encode", "__dataclass_fields__"):
        if not hasattr(kind, needed):
            raise TypeError(f"{kind.__name__} lacks {needed}")
    if _KINDS.get(kind.__name__, kind) is not kind and _KINDS[kind.__name__].__module__ != kind.__module__:
        raise ValueError(f"a codec {kind.__name__} exists")
    _KINDS[kind.__name__] = kind
    return kind


def _plain(feature) -> dict:
    d = {k: _plain(v) if type(v).__name__ in _KINDS else v for k, v in (feature.__dict__ if isinstance(feature, Sequence) else asdict(feature)).items()}
    return {"kind": type(feature).__name__} | {k: list(v) if isinstance(v, tuple) else v for k, v in d.items()}


def _built(d: dict):
    d = dict(d)
    kind = _KINDS[d.pop("kind")]
    return kind(**{k: _built(v) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in d.items()})


class Features(dict):
    """Field names and their logical types, in order."""

    def __init__(self, fields: dict):
        for name, f in fields.items():
            if type(f).__name__ not in _KINDS:
                raise TypeError(f"{name} is no feature")
        super().__init__(fields)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, f.spark_type(), True, {KEY: json.dumps(_plain(f))}) for n, f in self.items()])

    @classmethod
    def of(cls, schema: T.StructType) -> Features:
        """The features of a schema; a field without metadata is the value type that fits."""
        names = {json.dumps(t.jsonValue()): n for n, t in _PLAIN.items()}
        out = {}
        for f in schema.fields:
            if KEY in f.metadata:
                out[f.name] = _built(json.loads(f.metadata[KEY]))
            elif isinstance(f.dataType, T.ArrayType):
                out[f.name] = Sequence(Value(names.get(json.dumps(f.dataType.elementType.jsonValue()), "binary")))
            else:
                out[f.name] = Value(names.get(json.dumps(f.dataType.jsonValue()), "binary"))
        return cls(out)

    def encode(self, row: dict) -> dict:
        """A row of Spark values: missing fields are null, unknown ones are dropped."""
        return {n: f.encode(row.get(n)) for n, f in self.items()}


def fingerprint(schema: T.StructType) -> str:
    """Digest of names, types and logical types."""
    return hashlib.sha256(json.dumps([[f.name, f.dataType.jsonValue(), f.metadata.get(KEY, "")] for f in schema.fields]).encode()).hexdigest()

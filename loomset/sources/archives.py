"""Archive members, binary arrays, time-series text and sound files as DataFrames.

Files are listed by Spark's ``binaryFile`` source, so paths may be any that Spark reads and files spread over executors. Archives
are opened in their task as streams, and members come out of a Python generator one at a time, so neither an archive's bytes nor
what is in it are ever in memory as a whole; only a member is, since it is a cell. Arrays and sounds are read file by file.
"""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = "archive string, member string, content binary"
#: Bytes of content that one Arrow batch holds, at least one member.
BATCH = 8 << 20


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def opened(path: str):
    """A seekable stream of a file, by the file system that its address names."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path.removeprefix("file:") if path.startswith(("/", "file:")) else path
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def members_of(file, depth: int = 0) -> Iterator[tuple[str, bytes]]:
    """(member, content) of a zip or tar stream, also compressed; archives in it are opened down to ``depth`` levels."""
    if file.read(4)[:2] == b"PK":
        file.seek(0)
        with zipfile.ZipFile(file) as z:
            yield from _deeper(((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()), depth)
        return
    file.seek(0)
    with tarfile.open(fileobj=file, mode="r|*") as t:
        yield from _deeper(((m.name, t.extractfile(m).read()) for m in t if m.isfile()), depth)


def _deeper(inner, depth: int):
    for name, data in inner:
        if depth and name.lower().endswith((".zip", ".tar", ".tgz", ".tar.gz", ".tar.bz2")):
            for sub, part in members_of(io.BytesIO(data), depth - 1):
                yield f"{name}/{sub}", part
        else:
            yield name, data


def archive(spark: SparkSession, path: str, pattern: str | None = None, depth: int = 0, skip_broken: bool = False) -> DataFrame:
    """Rows (archive, member, content) of all zip and tar files under ``path``; ``depth`` opens archives in archives.

    A broken archive fails the query, or with ``skip_broken`` gives what can be read of it.
    """

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                try:
                    with opened(name) as file:
                        for member, content in members_of(file, depth):
                            rows.append((name, member, content))
                            size += len(content)
                            if size >= BATCH:
                                yield _rows(rows)
                                rows, size = [], 0
                except (tarfile.TarError, zipfile.BadZipFile, EOFError):
                    if not skip_broken:
                        raise
                yield _rows(rows)

    return _files(spark, path, pattern).select("path").mapInArrow(run, MEMBER)


def _rows(rows) -> pa.RecordBatch:
    a, m, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(m, pa.string()), pa.array(c, pa.binary())], ["archive", "member", "content"])


def folder(spark: SparkSession, path: str, pattern: str | None = None, level: int = 2) -> DataFrame:
    """Rows (path, label, content) of a tree with a folder a class: the label is the ``level``-th part from the end."""
    return _files(spark, path, pattern).select("path", F.element_at(F.split("path", "/"), -level).alias("label"), "content")


def parse_idx(data: bytes) -> np.ndarray:
    """The array of an IDX file, gzipped or not."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    zero, kind, dims = struct.unpack(">HBB", data[:4])
    kinds = {8: ">u1", 9: ">i1", 11: ">i2", 12: ">i4", 13: ">f4", 14: ">f8"}
    if zero or kind not in kinds:
        raise ValueError("not an IDX file")
    shape = struct.unpack(f">{dims}I", data[4 : 4 + 4 * dims])
    return np.frombuffer(data, kinds[kind], offset=4 + 4 * dims).reshape(shape)


_MATRIX = {0x1E3D4C51: "<f4", 0x1E3D4C53: "<f8", 0x1E3D4C54: "<i4", 0x1E3D4C55: "<u1", 0x1E3D4C56: "<i2"}


def parse_matrix(data: bytes) -> np.ndarray:
    """A binary matrix: magic number for the type, number of dimensions, at least three sizes, then the elements."""
    magic, dims = struct.unpack("<ii", data[:8])
    if magic not in _MATRIX:
        raise ValueError("unknown matrix type")
    stored = max(3, dims)
    shape = struct.unpack(f"<{stored}i", data[8 : 8 + 4 * stored])[:dims]
    return np.frombuffer(data, _MATRIX[magic], offset=8 + 4 * stored).reshape(shape)


def parse_columns(data: bytes, shape: tuple[int, ...], dtype: str = "uint8") -> np.ndarray:
    """Raw elements in column-major order, an item after the other."""
    one = int(np.prod(shape)) * np.dtype(dtype).itemsize
    flat = np.frombuffer(data, dtype).reshape(len(data) // one, -1)
    return np.stack([x.reshape(shape, order="F") for x in flat]) if len(flat) else np.zeros((0, *shape), dtype)


def parse_npy(data: bytes) -> dict[str, np.ndarray]:
    """Arrays of an NPY (named 'data') or NPZ file; pickled objects are refused."""
    got = np.load(io.BytesIO(data), allow_pickle=False)
    return {"data": got} if isinstance(got, np.ndarray) else {k: got[k] for k in got.files}


def array_rows(spark: SparkSession, path: str, parse, pattern: str | None = None) -> DataFrame:
    """Rows (path, array, idx, shape, dtype, content): each item along the first axis of the arrays that ``parse`` finds in a file."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = parse(data)
                for key, a in (got.items() if isinstance(got, dict) else [("data", got)]):
                    a = np.ascontiguousarray(a[None] if a.ndim == 0 else a)
                    a = a.astype(a.dtype.newbyteorder("="))
                    step = max(1, BATCH // max(1, a[:1].nbytes))
                    for i in range(0, len(a), step):
                        part = a[i : i + step]
                        n = len(part)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * n), pa.array([key] * n), pa.array(np.arange(i, i + n)), pa.array([list(a.shape[1:])] * n, pa.list_(pa.int32())), pa.array([str(a.dtype)] * n), pa.array([x.tobytes() for x in part], pa.binary())],
                            ["path", "array", "idx", "shape", "dtype", "content"],
                        )

    return _files(spark, path, pattern).mapInArrow(run, "path string, array string, idx bigint, shape array<int>, dtype string, content binary")


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples [T][C] as float32 of a PCM WAV file, not scaled."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8
    else:
        x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width])
    return rate, x.astype(np.float32).reshape(-1, channels)


def sounds(files: DataFrame, path: str = "path", content: str = "content", skip_broken: bool = False) -> DataFrame:
    """Rows (path, rate, series) of WAV files, from ``archive`` or ``folder``; broken ones fail, or are left out."""

    def run(batches):
        for b in batches:
            out = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rate, x = parse_wav(data)
                except (wave.Error, EOFError, KeyError):
                    if not skip_broken:
                        raise
                    continue
                out.append((name, rate, x.tolist()))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.list_(pa.float32())))], ["path", "rate", "series"])

    return files.select(path, content).mapInArrow(run, "path string, rate int, series array<array<float>>")


def ts_header(lines: Iterator[str]) -> dict:
    """Tags before the data: problemname, timestamps, univariate, classlabel (with its names), targetlabel."""
    head: dict = {"timestamps": False, "univariate": True, "classes": None, "target": False, "name": None}
    for line in lines:
        line = line.strip()
        if not line or line.startswith(("#", "%")):
            continue
        tag, *rest = line.lower().split()
        if tag == "@data":
            return head
        if tag == "@problemname":
            head["name"] = line.split()[1]
        elif tag in ("@timestamps", "@univariate"):
            head[tag[1:]] = rest[0] == "true"
        elif tag == "@classlabel" and rest[0] == "true":
            head["classes"] = line.split()[2:]
            if not head["classes"]:
                raise ValueError("class labels are announced but not given")
        elif tag == "@targetlabel":
            head["target"] = rest[0] == "true"
    raise ValueError("no @data")


def time_series(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line_no, series [dim][t] of (time, value), label) of a ``.ts`` file: ``:`` parts dimensions, ``,`` values, ``?`` is missing.

    The header is read on the driver; the data lines are parsed by built-in expressions. With timestamps values are
    ``(time,value)``; without, ``time`` is the position.
    """
    text = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    head = ts_header(r["value"] for r in text.toLocalIterator())  # stops at @data
    line = F.trim("value")
    data = text.where((line != "") & ~F.substring(line, 1, 1).isin("@", "#", "%")).select("n", F.regexp_replace(line, r"\s+", "").alias("s"))
    labelled = head["classes"] is not None or head["target"]
    parts = F.split("s", r":(?=\(|[^()]*(?:$|\())" if head["timestamps"] else ":")
    data = data.select("n", parts.alias("p"))
    dims = F.slice("p", F.lit(1), F.size("p") - (1 if labelled else 0))
    number = lambda x: F.when(x != "?", x.cast("double"))
    if head["timestamps"]:
        one = lambda d: F.transform(F.regexp_extract_all(d, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda v: F.struct(F.substring_index(v, ",", 1).alias("time"), number(F.substring_index(v, ",", -1)).alias("value")))
    else:
        one = lambda d: F.transform(F.split(d, ","), lambda v, i: F.struct(i.cast("string").alias("time"), number(v).alias("value")))
    label = F.element_at("p", -1) if labelled else F.lit(None).cast("string")
    return data.select(F.col("n").alias("line_no"), F.transform(dims, one).alias("series"), label.alias("label"))


def arff(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line_no, values, label) of an ARFF file's data: numbers, then the label in the last place; ``?`` is null."""
    text = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    line = F.trim("value")
    rows = text.where((line != "") & ~F.substring(line, 1, 1).isin("@", "%")).select("n", F.split(line, r"\s*,\s*").alias("p"))
    values = F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda v: v.try_cast("double"))
    return rows.select(F.col("n").alias("line_no"), values.alias("values"), F.regexp_replace(F.element_at("p", -1), "^['\"]|['\"]$", "").alias("label"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON list of objects, as rows; a file is read as a whole."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON object, as rows (key, value) of text."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True) -> DataFrame:
    """A table of text: ``sep`` None finds the separator (comma, semicolon, tab, bar) in the first line, ' ' is any white space."""
    if sep == " ":
        words = F.split(F.trim("value"), r"\s+")
        n = spark.read.text(path).select(F.max(F.size(words))).first()[0] or 0
        return spark.read.text(path).select(*[F.get(words, F.lit(i)).alias(f"c{i}") for i in range(n)])
    if sep is None:
        first = spark.read.text(path).first()
        sep = max(",;\t|", key=(first[0] if first else "").count)
    df = spark.read.csv(path, header=header, sep=sep)
    if header and not df.columns:
        raise ValueError(f"{path} is empty")
    return df

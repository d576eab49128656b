"""Raw files written by tasks: archives, arrays, sounds, trees of files and Arrow shards, one or several files a partition.

A task writes under a name of its own and renames when it is done, so a task that runs again leaves one file. Folders are
mounted paths that tasks and driver share; ``file:`` in front is taken off.
"""

from __future__ import annotations

import io
import os
import struct
import tarfile
import uuid
import wave
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from loomset.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, as a path that tasks can open."""
    root = shared_folder(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"raw files are written to mounted paths, not to {root}")
    path = os.path.join("/" + root.removeprefix("file:").lstrip("/"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def by_task(df: DataFrame, folder: str, suffix: str, write: Callable[[str, Iterator[pa.RecordBatch]], int]) -> int:
    """Let each task write its partition to one file of ``folder``; returns the number of rows that ``write`` gives. Empty partitions have no file."""

    def run(batches):
        n, name = TaskContext.get().partitionId(), os.path.join(folder, f".{uuid.uuid4().hex}.tmp")
        rows = write(name, batches)
        if rows and os.path.exists(name):
            os.replace(name, os.path.join(folder, f"part-{n:05d}{suffix}"))
        elif os.path.exists(name):
            os.remove(name)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    return df.mapInArrow(run, "rows bigint").groupBy().sum("rows").first()[0] or 0


def _members(batches) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), (c.encode() if isinstance(c, str) else c for c in b.column(1).to_pylist()), strict=True)


def zip_members(path: str, batches) -> int:
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in _members(batches):
            z.writestr(name, data)
            n += 1
    return n


def _add(t: tarfile.TarFile, name: str, data: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size = len(data)
    t.addfile(info, io.BytesIO(data))


def tar_members(path: str, batches, mode: str = "w:gz") -> int:
    n = 0
    with tarfile.open(path, mode) as t:
        for name, data in _members(batches):
            _add(t, name, data)
            n += 1
    return n


def nested_members(path: str, batches, each: int = 10) -> int:
    """A tar of zips of ``each`` members."""
    n, members = 0, _members(batches)
    with tarfile.open(path, "w") as t:
        while some := [m for _, m in zip(range(each), members)]:
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w") as z:
                for name, data in some:
                    z.writestr(name, data)
            _add(t, f"inner/{n}.zip", raw.getvalue())
            n += len(some)
    return n


def tree(folder: str) -> Callable:
    """One file a row, (relative path, content), under ``folder``."""

    def write(_: str, batches) -> int:
        n = 0
        for name, data in _members(batches):
            at = os.path.join(folder, name)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(f"{at}.tmp", "wb") as f:
                f.write(data)
            os.replace(f"{at}.tmp", at)
            n += 1
        return n

    return write


def stacked(batches) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of a partition's (id, array) rows; arrays are of one length."""
    ids, rows = [np.zeros(0, np.int64)], []
    for b in batches:
        ids.append(b.column(0).to_numpy())
        rows.append(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0), np.float32))
    rows = [r for r in rows if len(r)]
    return np.concatenate(ids), np.concatenate(rows) if rows else np.zeros((0, 0), np.float32)


def idx_bytes(a: np.ndarray) -> bytes:
    kind = {"u1": 8, "i1": 9, "i2": 11, "i4": 12, "f4": 13, "f8": 14}[a.dtype.str[1:]]
    return struct.pack(f">HBB{a.ndim}I", 0, kind, a.ndim, *a.shape) + a.astype(a.dtype.newbyteorder(">")).tobytes()


def matrix_bytes(a: np.ndarray) -> bytes:
    magic = {"f4": 0x1E3D4C51, "f8": 0x1E3D4C53, "i4": 0x1E3D4C54, "u1": 0x1E3D4C55, "i2": 0x1E3D4C56}[a.dtype.str[1:]]
    shape = [*a.shape, *[1] * (3 - a.ndim)]
    return struct.pack(f"<ii{len(shape)}i", magic, a.ndim, *shape) + a.astype(a.dtype.newbyteorder("<")).tobytes()


def arrays(make: Callable[[np.ndarray, np.ndarray], bytes]) -> Callable:
    """One file a partition, of the bytes that ``make`` gives for its ids and matrix."""

    def write(path: str, batches) -> int:
        ids, x = stacked(batches)
        if len(ids):
            with open(path, "wb") as f:
                f.write(make(ids, x))
        return len(ids)

    return write


def npz_bytes(**named: np.ndarray) -> bytes:
    raw = io.BytesIO()
    np.savez(raw, **named)
    return raw.getvalue()


def npy_bytes(a: np.ndarray) -> bytes:
    raw = io.BytesIO()
    np.save(raw, a)
    return raw.getvalue()


def wav_bytes(samples: np.ndarray, rate: int = 16_000) -> bytes:
    """16-bit mono."""
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return raw.getvalue()


def wav_archive(path: str, batches) -> int:
    """A zip of one sound a row (id, samples), named by id."""
    n = 0
    with zipfile.ZipFile(path, "w") as z:
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z.writestr(f"audio/{k}.wav", wav_bytes(np.array(x)))
                n += 1
    return n


def arrow_shard(path: str, batches) -> int:
    n, out = 0, None
    for b in batches:
        if b.num_rows:
            out = out or pa.ipc.new_file(path, b.schema)
            out.write_batch(b)
            n += b.num_rows
    if out is not None:
        out.close()
    return n

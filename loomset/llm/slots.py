"""Hashes packed by the slot that owns their range, and Bloom filters of one part a slot.

A task's hashes are gathered over its batches before they are packed, so that a row of a slot holds many of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm import textkit

#: Bits of filter per hash and hash functions: about 0.05 % false positives.
BITS, PROBES = 16, 6
#: Hashes that a task gathers before it packs them.
GATHER = 1 << 20


def _positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = textkit.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    x = textkit.mix(h)
    for _ in range(PROBES):
        yield x % np.uint64(bits)
        x = x + step


def bloom_bits(n: int) -> int:
    return max(64, -(-n * BITS // 8) * 8)


def bloom_add(filter_: np.ndarray, h: np.ndarray) -> None:
    for at in _positions(h, len(filter_) * 8):
        np.bitwise_or.at(filter_, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))


def bloom_has(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _positions(h, len(filter_) * 8):
        out &= (filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def filter_of(h: np.ndarray) -> np.ndarray:
    filter_ = np.zeros(bloom_bits(len(h)) // 8, np.uint8)
    bloom_add(filter_, h)
    return filter_


def suspects_of(h: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """The hashes that the once-seen filter has already when they come again: a superset of the repeated ones."""
    once = np.zeros(bloom_bits(len(h)) // 8, np.uint8)
    found = []
    for k in range(0, len(h), block):
        part, counts = np.unique(h[k : k + block], return_counts=True)
        found.append(part[(counts > 1) | bloom_has(once, part)])
        bloom_add(once, part)
    return np.unique(np.concatenate(found)) if found else h[:0]


def slot_of(h: np.ndarray, slots: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def packed(rows: Iterator[dict[str, np.ndarray]], slots: int, by=None, gather: int = GATHER) -> Iterator[pa.RecordBatch]:
    """Rows (slot, and each column's values as bytes); ``by`` gives the hashes that decide on the slot, else the first column does."""

    def flush(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        columns = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        slot = slot_of(by(columns) if by else next(iter(columns.values())), slots)
        order = np.argsort(slot, kind="stable")
        which, at = np.unique(slot[order], return_index=True)
        raw = [pa.array([x.tobytes() for x in np.split(a[order], at[1:])] if len(which) else [], pa.binary()) for a in columns.values()]
        return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *raw], ["slot", *columns])

    parts, size = [], 0
    for row in rows:
        parts.append(row)
        size += len(next(iter(row.values())))
        if size >= gather:
            yield flush(parts)
            parts, size = [], 0
    if parts:
        yield flush(parts)


def unpacked(t: pa.Table, **kinds) -> list[np.ndarray]:
    """The columns' values; they are copied once, as they may be large."""
    return [np.frombuffer(b"".join(_values(chunk) for chunk in t[c].chunks if len(chunk)), kind) for c, kind in kinds.items()]


def _values(chunk: pa.Array) -> memoryview:
    _, offsets, values = chunk.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
    return memoryview(values)[int(at[0]) : int(at[-1])] if values is not None else memoryview(b"")


class Filters:
    """Filters of all slots in one array; a slot without a filter has none of the hashes."""

    def __init__(self, parts: dict[int, bytes], slots: int):
        self.slots = slots
        self.start, self.bits = np.zeros(slots, np.int64), np.zeros(slots, np.uint64)
        at = 0
        for s, x in parts.items():
            self.start[s], self.bits[s] = at, len(x) * 8
            at += len(x)
        self.bytes = np.frombuffer(b"".join(parts.values()), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which hashes the filter of their slot has."""
        slot = slot_of(h, self.slots)
        out = self.bits[slot] > 0
        at = np.flatnonzero(out)
        h, slot = h[at], slot[at]
        start, bits = self.start[slot], self.bits[slot]
        step = textkit.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
        x = textkit.mix(h)
        left = np.arange(len(h))
        for _ in range(PROBES):  # those that a probe rules out aren't looked at again
            p = x[left] % bits[left]
            left = left[(self.bytes[start[left] + (p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            x = x + step
        out[:] = False
        out[at[left]] = True
        return out


def opened(filters, slots: int) -> Filters:
    """The parts of a broadcast filter; a worker keeps them with the broadcast."""
    if not hasattr(filters, "_opened"):
        filters._opened = Filters(filters.value, slots)
    return filters._opened


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def key_filter(keys: DataFrame, slots: int, limit: int):
    """A broadcast filter of the hashes of ``keys``' only column, built by slot; None if it is larger than ``limit`` bytes."""

    def pack(batches):
        yield from packed(({"h": b.column(0).to_numpy().view(np.uint64)} for b in batches), slots)

    def build(t: pa.Table) -> pa.Table:
        (h,) = unpacked(t, h=np.uint64)
        return pa.table({"slot": pa.array([t["slot"][0].as_py()], pa.int32()), "f": pa.array([filter_of(np.unique(h)).tobytes()], pa.binary())})

    if keys.count() * BITS // 8 > limit:
        return None
    parts = keys.select(key_hash(keys[keys.columns[0]]).alias("h")).mapInArrow(pack, "slot int, h binary").groupBy("slot").applyInArrow(build, "slot int, f binary")
    return keys.sparkSession.sparkContext.broadcast({r["slot"]: bytes(r["f"]) for r in parts.toLocalIterator()})


def may_have(filters, slots: int):
    """A function of a column of key hashes: whether the broadcast filter has them. Only the hashes go to Python."""

    @F.arrow_udf("boolean")
    def hit(h: pa.Array) -> pa.Array:
        return pa.array(opened(filters, slots).has(h.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    return hit

"""Datasets declared as a query over raw assets: each split is a DataFrame, built once into a sharded table and opened after.

A builder is a table function with a cache. The queries below are one for each shape of raw data: list files joined by an id, arrays
with levels by position, factors by mixed radix, facts in file names, sound files with a table of metadata, templates with
defaults, and folders by class.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset import storage
from loomset.dataset import Dataset
from loomset.features import ClassLabel, Features, Image, Sequence, Value
from loomset.sources import archives
from loomset.sources.fetch import locked

Query = Callable[[SparkSession, dict], DataFrame]
ALIASES = {"val": "validation", "valid": "validation", "dev": "validation"}


@dataclass(frozen=True)
class Builder:
    """``splits`` gives a query for each split; its columns are those of ``features`` and a sort key ``key``."""

    name: str
    features: Features
    splits: dict[str, Query]
    version: str = "1.0.0"
    config: str = "default"
    options: dict = field(default_factory=dict)

    def cache_key(self, split: str) -> str:
        return hashlib.sha256(f"{self.name}:{self.version}:{self.config}:{split}:parquet".encode()).hexdigest()[:16]

    def folder(self, root: str, split: str) -> str:
        return os.path.join(root, f"{self.name}_{self.config}_{split}_{self.cache_key(split)}")

    def build(self, spark: SparkSession, assets: dict, root: str, split: str | None = None) -> Dataset | dict[str, Dataset]:
        """One split, or all by name. Of several processes one builds a table; the others wait and open it."""
        if split is None:
            return {ALIASES.get(s, s): self.build(spark, assets, root, s) for s in self.splits}
        split = split if split in self.splits else next((s for s in self.splits if ALIASES.get(s, s) == ALIASES.get(split, split)), split)
        if split not in self.splits:
            raise ValueError(f"{self.name} has no split {split}; it has {sorted(self.splits)}")
        path = self.folder(root, split)
        done = os.path.join(path, storage.MANIFEST)
        if not os.path.exists(done):
            with locked(path):
                if not os.path.exists(done):  # another process may have built it meanwhile
                    rows = self.splits[split](spark, assets)
                    fields = [F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in self.features.schema().fields]
                    storage.write(rows.select("key", *fields), path, order=["key"], drop=["key"], **self.options)
        return Dataset.open(spark, path, self.features)


def split_or_fallback(found: dict[str, Dataset], want: str = "validation", labelled: Callable[[Dataset], bool] = lambda d: True, holdout: float = 0.1) -> Dataset:
    """The validation rows: that split, else a labelled test split, else a share held out of the training rows."""
    if want in found:
        return found[want]
    if "test" in found and labelled(found["test"]):
        return found["test"]
    return found["train"].train_test_split(holdout)["test"]


REGISTRY: dict[str, Builder] = {}


def register(builder: Builder) -> Builder:
    REGISTRY[builder.name.lower()] = builder
    return builder


def lookup(name: str) -> Builder:
    """By name, in any case."""
    if name.lower() not in REGISTRY:
        raise KeyError(f"{name} is not among {sorted(REGISTRY)}")
    return REGISTRY[name.lower()]


# ---- shapes of raw data


def _base(path: str = "member") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _list_file(members: DataFrame, name: str, *columns: str) -> DataFrame:
    """A white-space separated list among the members."""
    lines = members.where(_base() == name).select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("line")).where(F.trim("line") != "")
    words = F.split(F.trim("line"), r"\s+")
    return lines.select(*[words[i].alias(c) for i, c in enumerate(columns)])


def listed_images(split: str) -> Query:
    """An archive of images with lists of paths, classes (from 1) and training flags by image id: three joins."""

    def rows(spark: SparkSession, assets: dict) -> DataFrame:
        m = archives.archive(spark, assets["archive"])
        ids = _list_file(m, "images.txt", "image_id", "path").join(_list_file(m, "image_class_labels.txt", "image_id", "class"), "image_id")
        ids = ids.join(_list_file(m, "train_test_split.txt", "image_id", "is_train"), "image_id").where(F.col("is_train") == ("1" if split == "train" else "0"))
        pictures = m.where(F.col("member").endswith(".jpg") | F.col("member").endswith(".png")).select(F.regexp_extract("member", "images/(.*)", 1).alias("path"), "content")
        return ids.join(pictures, "path").select(F.col("image_id").cast("long").alias("key"), F.col("content").alias("image"), (F.col("class").cast("long") - 1).alias("label"))

    return rows


def levelled_arrays(per_level: int) -> Query:
    """An archive of one array a corruption and one of labels; the level is the block of positions, labels repeat over levels."""

    def rows(spark: SparkSession, assets: dict) -> DataFrame:
        m = archives.archive(spark, assets["archive"]).where(F.col("member").endswith(".npy"))

        def items(batches):
            import pyarrow as pa

            for b in batches:
                for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    a = np.ascontiguousarray(archives.parse_npy(data)["data"])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(a)), pa.array(range(len(a)), pa.int64()), pa.array([x.tobytes() for x in a], pa.binary()), pa.array(a.tolist() if a.ndim == 1 else [None] * len(a), pa.int64())], ["name", "pos", "image", "value"])

        all_ = m.select(F.regexp_extract("member", r"([^/]+)\.npy$", 1).alias("name"), "content").mapInArrow(items, "name string, pos bigint, image binary, value bigint")
        labels = all_.where("name = 'labels'").select("pos", F.col("value").alias("label"))
        return all_.where("name <> 'labels'").join(labels, "pos").select(
            F.struct("name", "pos").alias("key"), "image", "label", F.col("name").alias("corruption_name"), (F.floor(F.col("pos") / per_level) + 1).cast("int").alias("corruption_level")
        )

    return rows


def factor_arrays(sizes: dict[str, int]) -> Query:
    """Arrays of images whose position counts through the factors, the last one fastest."""

    def rows(spark: SparkSession, assets: dict) -> DataFrame:
        a = archives.array_rows(spark, assets["array"], archives.parse_npy).where("array in ('images', 'data')")
        base, columns = 1, []
        for name, n in reversed(list(sizes.items())):
            columns.append((F.floor(F.col("idx") / base) % n).cast("int").alias(name))
            base *= n
        return a.select(F.col("idx").alias("key"), F.col("content").alias("image"), *columns[::-1])

    return rows


def named_files(pattern: str, columns: dict[str, str]) -> Query:
    """An archive of images whose names hold the facts: capture groups by column, with their types; other names are left out."""

    def rows(spark: SparkSession, assets: dict) -> DataFrame:
        m = archives.archive(spark, assets["archive"]).where(_base().rlike(pattern))
        return m.select(F.col("member").alias("key"), F.col("content").alias("image"), *[F.regexp_extract(_base(), pattern, i + 1).cast(kind).alias(c) for i, (c, kind) in enumerate(columns.items())])

    return rows


def described_sounds(labels: ClassLabel, name: str = "fname", label: str = "label", defaults: dict[str, str] | None = None) -> Query:
    """Archives of WAV files joined with a table by file name; columns that the table lacks take their defaults."""

    def rows(spark: SparkSession, assets: dict) -> DataFrame:
        t = archives.delimited(spark, assets["table"])
        s = archives.sounds(archives.archive(spark, assets["archive"]).where(F.lower("member").endswith(".wav")).select(F.col("member").alias("path"), "content"))
        extra = [(F.coalesce(F.col(c), F.lit(v)) if c in t.columns else F.lit(v)).alias(c) for c, v in (defaults or {}).items()]
        t = t.select(F.col(name).alias("file"), labels.encoded(F.col(label)).alias("label"), *extra)
        return s.withColumn("file", _base("path")).join(t, "file").select(F.col("file").alias("key"), "series", "label", *(defaults or {}))

    return rows


def templated_clips(split: str) -> Query:
    """Clips by id with annotation lists: templates without brackets give the label, -1 if there is none."""

    def rows(spark: SparkSession, assets: dict) -> DataFrame:
        notes = spark.read.option("multiLine", True).json(assets[split]).select("id", F.translate("template", "[]", "").alias("template"))
        names = spark.read.option("multiLine", True).schema("labels map<string,string>").json(assets["labels"])
        known = names.select(F.explode("labels").alias("template", "label"))
        clips = archives.folder(spark, assets["clips"]).select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("id"), "path")
        return clips.join(notes, "id").join(known, "template", "left").select(F.col("id").alias("key"), "path", "template", F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label"))

    return rows


def class_folders(labels: ClassLabel) -> Query:
    """A tree with a folder a class; folders of other names are left out."""

    def rows(spark: SparkSession, assets: dict) -> DataFrame:
        f = archives.folder(spark, assets["folder"]).where(F.col("label").isin(*labels.names))
        return f.select(F.col("path").alias("key"), F.col("content").alias("image"), labels.encoded(F.col("label")).alias("label"))

    return rows


def images_with(**more) -> Features:
    return Features({"image": Image(), **more})


def sounds_with(**more) -> Features:
    return Features({"series": Sequence(Sequence(Value("float32"))), **more})

"""A map-style dataset over a DataFrame: dense positions, views, filters, maps, columns, formats, splits and epochs.

Views are DataFrames with the position of each row in them. Slices, selections, permutations, columns, maps of rows and filters are
lazy but for row counts; a filter leaves gaps between positions, which close when someone asks for a position. What opens a
DataFrame without positions, a batched map that changes the number of rows, and closing gaps write the rows' order once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset import storage
from loomset.features import Features, Image, Sequence, Value, Video, VideoDecode
from loomset.functions.vision import channels_first
from loomset.operators import ordering, selection
from loomset.operators.selection import POS

FORMATS = (None, "raw", "numpy", "channels", "arrow", "pandas")


class Dataset:
    """``rows`` holds the columns and POS, which orders the rows of this view; ``df`` has the same rows with POS dense from 0."""

    def __init__(self, df: DataFrame, features: Features, *, num_rows: int | None = None, fmt: str | None = None, transform: Callable | None = None, decode: bool = True, dense: bool = True, video: VideoDecode | None = None):
        self.rows, self._dense, self.features, self._n, self.format, self.transform, self.decode, self.video = df, dense, features, num_rows, fmt, transform, decode, video

    @property
    def df(self) -> DataFrame:
        if not self._dense:
            # only the positions are numbered anew; the columns join them
            at = selection.with_positions(self.rows.select(F.col(POS).alias("__old")), "__old")
            self.rows, self._dense = self.rows.withColumnRenamed(POS, "__old").join(at, "__old").drop("__old"), True
        return self.rows

    # ---- opening and writing

    @classmethod
    def from_dataframe(cls, df: DataFrame, *order: str | Column, features: Features | None = None) -> Dataset:
        return cls(selection.with_positions(df, *order), features or Features.of(df.schema))

    @classmethod
    def from_rows(cls, spark: SparkSession, features: Features, rows: list[dict]) -> Dataset:
        """Encode rows on the driver: for small tables and tests."""
        names = list(features)
        data = [tuple(e[n] for n in names) + (i,) for i, e in enumerate(map(features.encode, rows))]
        schema = features.schema().add(POS, "long")
        return cls(spark.createDataFrame(data, schema), features, num_rows=len(data))

    @classmethod
    def open(cls, spark: SparkSession, path: str, features: Features | None = None) -> Dataset:
        df = storage.open_table(spark, path, features.schema() if features else None)
        names = [c for c in df.columns if c not in (storage.ROW, storage.SHARD)]
        found = Features.of(df.select(*names).schema)
        return cls(df.withColumnRenamed(storage.ROW, POS).drop(storage.SHARD), features or found, num_rows=storage.manifest_of(path)["num_rows"])

    def write(self, path: str, **options) -> dict:
        """Materialise the view with fresh row ids in its order; the logical types go with the schema."""
        fields = [F.col(f.name).alias(f.name, metadata=f.metadata) for f in self.features.schema().fields]
        return storage.write(self.df.select(POS, *fields), path, order=[POS], drop=[POS], **options)

    # ---- what it is

    @property
    def column_names(self) -> list[str]:
        return list(self.features)

    @property
    def num_rows(self) -> int:
        if self._n is None:
            self._n = self.rows.count()
        return self._n

    def __len__(self) -> int:
        return self.num_rows

    def info(self) -> dict:
        return {"num_rows": self.num_rows, "features": dict(self.features), "format": self.format}

    def _view(self, df: DataFrame, n: int | None = None, features: Features | None = None, **changes) -> Dataset:
        keep = {"fmt": self.format, "transform": self.transform, "decode": self.decode, "video": self.video} | changes
        return Dataset(df, features or self.features, num_rows=n, **keep)

    # ---- positions

    def __getitem__(self, at):
        if isinstance(at, str):
            return [r[0] for r in self.rows.orderBy(POS).select(at).toLocalIterator()]
        if isinstance(at, slice):
            start, stop, step = at.indices(self.num_rows)
            view = selection.sliced(self.df, start, stop, step, slot="__slot")
            return self._view(view.drop(POS).withColumnRenamed("__slot", POS), len(range(start, stop, step)))
        if isinstance(at, (list, tuple, np.ndarray)):
            return list(self.select(list(at)))
        i = self._checked(int(at))
        return self._out([self.df.where(F.col(POS) == i).first()])[0]

    def _checked(self, i: int) -> int:
        n = self.num_rows
        if not -n <= i < n:
            raise IndexError(f"index {i} is out of range for {n} rows")
        return i % n if n else i

    def select(self, indices: list[int]) -> Dataset:
        """View of the rows at ``indices``, in that order, with duplicates."""
        at = [self._checked(int(i)) for i in indices]
        if (run := selection.contiguous(at)) is not None:
            return self[run[0] : run[1]]
        view = selection.at_indices(self.df, at, slot="__slot")
        return self._view(view.drop(POS).withColumnRenamed("__slot", POS), len(at))

    def take(self, n: int) -> Dataset:
        return self[:n]

    def filter(self, predicate: str | Column | Callable, batched: bool = False) -> Dataset:
        """Rows that a SQL text, a column or a Python function accepts; the first two reach the scan.

        A function sees raw values: a dict a row, or with ``batched`` a dict of lists, and gives a bool or a list of them.
        """
        if callable(predicate) and not isinstance(predicate, Column):
            names = self.column_names

            def run(batches):
                for b in batches:
                    cols = b.to_pydict()
                    keep = predicate({n: cols[n] for n in names}) if batched else [predicate({n: cols[n][i] for n in names}) for i in range(b.num_rows)]
                    yield b.filter(pa.array([bool(k) for k in keep], pa.bool_()))

            kept = self.rows.mapInArrow(run, self.rows.schema)
        else:
            kept = self.rows.where(predicate)
        return self._view(kept, dense=False)

    def shuffle(self, seed: int = 42) -> Dataset:
        view = selection.shuffled(self.df.withColumnRenamed(POS, "__old"), seed, "__old").drop("__old")
        return self._view(view, self._n)

    def train_test_split(self, test_size: float = 0.1, seed: int = 42) -> dict[str, Dataset]:
        """Disjoint and complete: a permutation cut at floor(n * (1 - test_size))."""
        mixed, n = self.shuffle(seed), self.num_rows
        cut = int(n * (1 - test_size))
        return {"train": mixed[:cut], "test": mixed[cut:n]}

    def sample(self, size: int, seed: int = 0) -> Dataset:
        """Exactly ``size`` rows without replacement, in their order."""
        return self._view(selection.sample_exact(self.df, size, seed, POS), min(size, self.num_rows), dense=False)

    # ---- columns

    def add_column(self, name: str, values: list | np.ndarray | str | Column) -> Dataset:
        """A column from an expression, or from a list with a value for each position."""
        if name in self.features:
            raise ValueError(f"column {name} exists")
        if isinstance(values, (str, Column)):
            df, dense = self.rows.withColumn(name, F.expr(values) if isinstance(values, str) else values), self._dense
        else:
            values = values.tolist() if isinstance(values, np.ndarray) else list(values)
            if len(values) != self.num_rows:
                raise ValueError(f"{len(values)} values for {self.num_rows} rows")
            if any(isinstance(v, dict) for v in values):
                raise TypeError("a column of structs can't be added")
            extra = self.df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"{POS} bigint, `{name}` {_inferred(values)}")
            df, dense = self.df.join(extra, POS), True
        return self._view(df, self._n, Features({**self.features, name: _feature(df, name)}), dense=dense)

    def remove_columns(self, names: str | list[str]) -> Dataset:
        names = [names] if isinstance(names, str) else names
        return self._view(self.rows.drop(*names), self._n, Features({k: v for k, v in self.features.items() if k not in names}), dense=self._dense)

    def rename_column(self, old: str, new: str) -> Dataset:
        return self.rename_columns({old: new})

    def rename_columns(self, names: dict[str, str]) -> Dataset:
        """Unknown old names are ignored."""
        return self._view(self.rows.withColumnsRenamed(names), self._n, Features({names.get(k, k): v for k, v in self.features.items()}), dense=self._dense)

    def map(self, f: dict[str, str | Column] | Callable, schema=None, *, batched: bool = False, with_indices: bool = False, remove_columns: list[str] = ()) -> Dataset:
        """Columns from expressions, or rows from a Python function with a declared ``schema``.

        A function sees raw values: a dict (and the position), or with ``batched`` a dict of lists (and positions), and gives the
        same shape; a batched one may change the number of rows, which are then numbered anew.
        """
        if isinstance(f, dict):
            df = self.rows.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in f.items()}).drop(*remove_columns)
            names = [c for c in df.columns if c != POS]
            return self._view(df, self._n, Features({n: self.features[n] if n in self.features and n not in f else _feature(df, n) for n in names}), dense=self._dense)
        from pyspark.sql import types as T

        if schema is None:
            schema = self._probed(f, batched, with_indices)
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names, new = self.column_names, [x.name for x in schema.fields]
        carried = [n for n in names if n not in new and n not in remove_columns]
        out = T.StructType([*(self.df.schema[n] for n in carried), *schema.fields, T.StructField(POS, T.LongType()), T.StructField("__sub", T.LongType())])

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            target = to_arrow_schema(out)
            for b in batches:
                cols = b.to_pydict()
                at = cols[POS]
                data = {n: cols[n] for n in names}
                if batched:
                    got = f(data, at) if with_indices else f(data)
                    m = len(next(iter(got.values()))) if got else 0
                    same = m == b.num_rows
                    if not same and any(n not in got for n in carried):
                        raise ValueError("a map that changes the number of rows must give or remove every column")
                    rows = {n: got.get(n, data.get(n)) for n in [*carried, *new]}
                    rows |= {POS: at if same else [at[0]] * m if at else [], "__sub": list(range(m))}
                else:
                    made = [f({n: v[i] for n, v in data.items()}, *([at[i]] if with_indices else [])) for i in range(b.num_rows)]
                    rows = {n: [d.get(n, data[n][i] if n in data else None) for i, d in enumerate(made)] for n in [*carried, *new]} | {POS: at, "__sub": [0] * b.num_rows}
                yield pa.RecordBatch.from_pydict(rows, schema=target)

        mapped = self.df.mapInArrow(run, out)
        if batched:
            mapped = selection.with_positions(mapped.withColumnRenamed(POS, "__old"), "__old", "__sub").drop("__old")
        df = mapped.drop("__sub")
        return self._view(df, None if batched else self._n, Features({n: self.features[n] if n in self.features and n not in new else _feature(df, n) for n in [*carried, *new]}))

    def _probed(self, f: Callable, batched: bool, with_indices: bool):
        """Schema of what a Python function gives for the first row: columns that exist keep their type, others take the value's."""
        from pyspark.sql import types as T

        first = self.rows.orderBy(POS).limit(1).toArrow().to_pydict()
        if not first[POS]:
            raise ValueError("an empty dataset gives no row to infer the schema from")
        data = {n: first[n] if batched else first[n][0] for n in self.column_names}
        got = f(data, *([first[POS] if batched else first[POS][0]] if with_indices else []))
        return T.StructType([self.rows.schema[n] if n in self.features else T.StructField(n, T._parse_datatype_string(_inferred(list(v) if batched else [v]))) for n, v in got.items()])

    # ---- what comes out

    def with_format(self, fmt: str | None) -> Dataset:
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt}")
        return self._view(self.rows, self._n, fmt=fmt, dense=self._dense)

    def with_transform(self, f: Callable) -> Dataset:
        """A function of each row as it comes out, after formatting."""
        return self._view(self.rows, self._n, transform=f, dense=self._dense)

    def set_decode(self, decode: bool) -> Dataset:
        return self._view(self.rows, self._n, decode=decode, dense=self._dense)

    def set_video_decode(self, policy: VideoDecode | dict | None = None, **options) -> Dataset:
        """How video columns decode when rows come out: a policy, its options, or None for references."""
        if isinstance(policy, dict):
            policy = VideoDecode(**policy, **options)
        elif policy is None and options:
            policy = VideoDecode(**options)
        if policy is not None and not any(isinstance(f, Video) for f in self.features.values()):
            raise ValueError("no column is a video")
        return self._view(self.rows, self._n, video=policy, dense=self._dense)

    def _decoded(self, name: str, value, row: dict, at: int):
        feature = self.features[name]
        if isinstance(feature, Video) and self.video is not None and value is not None:
            return self.video.frames(value, row, at)
        return feature.decode(value) if hasattr(feature, "decode") else value

    def _out(self, rows: list) -> list:
        out = []
        for r in rows:
            d = {n: r[n] for n in self.column_names}
            if self.format != "raw" and self.decode:
                raw = dict(d)
                d = {n: self._decoded(n, v, raw, r[POS]) for n, v in d.items()}
            if self.format == "numpy":
                d = {n: np.asarray(v) if isinstance(v, list) else v for n, v in d.items()}
            elif self.format == "channels":
                # images as float32 CHW in [0, 1], numbers and lists as arrays: what a tensor library takes without a copy
                d = {n: channels_first(v) if isinstance(self.features[n], Image) and v is not None and not isinstance(v, bytes) else np.asarray(v) if isinstance(v, (list, int, float)) else v for n, v in d.items()}
            out.append(self.transform(d) if self.transform else d)
        return out

    def _shaped(self, rows: list):
        """A batch of rows in the dataset's format."""
        if self.format not in ("arrow", "pandas"):
            return self._out(rows)
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.rows.select(*self.column_names).schema)
        batch = pa.Table.from_pylist([r.asDict(True) for r in rows], schema=schema)
        return batch if self.format == "arrow" else batch.to_pandas()

    def to_arrow(self):
        return self.rows.orderBy(POS).select(*self.column_names).toArrow()

    def to_pandas(self):
        return self.rows.orderBy(POS).select(*self.column_names).toPandas()

    def __iter__(self) -> Iterator[dict]:
        """Rows in order; in the formats arrow and pandas each is a table of one row."""
        for r in self.rows.orderBy(POS).toLocalIterator(prefetchPartitions=True):
            if self.format in ("arrow", "pandas"):
                yield self._shaped([r])
            else:
                yield from self._out([r])

    def iter_batches(self, size: int = 128) -> Iterator:
        for rows in ordering.batches(self.rows, size, [F.col(POS)]):
            yield self._shaped(rows)

    def make_sampler(self, kind: str = "shard_shuffle", **options) -> ordering.Sampler:
        """An order of positions by epoch: 'sequential', 'random', 'shard_shuffle' or 'buffer'."""
        return ordering.Sampler(kind, **options)

    def as_iterable(self, sampler: ordering.Sampler | None = None, **options) -> Epochs:
        """Rows epoch by epoch, for one worker of several."""
        return Epochs(self, sampler or ordering.Sampler(), **options)

    def epoch(self, *, seed: int | None = None, epoch: int = 0, shard_rows: int = 10_000, within: str = "random", worker: int = 0, workers: int = 1) -> DataFrame:
        """Rows of an epoch in order (column ``order``): shards by hash, rows of a shard together; without seed in position order.

        Shards are ``shard_rows`` successive positions. A worker gets whole shards if there are enough, else every n-th row.
        """
        df = self.df.withColumn("__shard", F.floor(F.col(POS) / shard_rows))
        df = ordering.for_worker(df, worker, workers, "__shard", POS, -(-self.num_rows // shard_rows))
        if seed is None:
            return selection.with_positions(df, POS, name="order").drop("__shard")
        return ordering.epoch_positions(df, seed, epoch, "__shard", POS, "order", within).drop("__shard")


class Epochs:
    """Iterates over the rows of one worker in a sampler's order; ``set_epoch`` changes the permutation."""

    def __init__(self, data: Dataset, sampler: ordering.Sampler, worker: int = 0, workers: int = 1):
        if not 0 <= worker < workers:
            raise ValueError("worker is out of range")
        self.data, self.sampler, self.worker, self.workers, self.epoch = data, sampler, worker, workers, 0

    def set_epoch(self, epoch: int) -> None:
        self.epoch = epoch

    def frame(self) -> DataFrame:
        """The worker's rows with their place in ``order``."""
        return self.sampler.positions(self.data.df, POS, self.epoch, self.worker, self.workers, self.data.num_rows)

    def __iter__(self) -> Iterator[dict]:
        for r in self.frame().orderBy("order").toLocalIterator(prefetchPartitions=True):
            yield from self.data._out([r])


def concatenate(parts: list[Dataset]) -> Dataset:
    """All rows, part after part; missing columns are null."""
    out, base = None, 0
    for p in parts:
        shifted = p.df.withColumn(POS, F.col(POS) + base)
        base += p.num_rows
        out = shifted if out is None else out.unionByName(shifted, allowMissingColumns=True)
    features: dict = {}
    for p in parts:
        features = {**p.features, **features}
    return Dataset(out, Features(features), num_rows=base)


def _inferred(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    for kind, name in ((bool, "boolean"), (int, "bigint"), (float, "double"), (str, "string"), (bytes, "binary")):
        if kinds <= ({int, float} if kind is float else {kind}):
            return name
    if kinds == {list}:
        return f"array<{_inferred([x for v in values if v is not None for x in v])}>"
    raise TypeError(f"can't infer a type from {sorted(k.__name__ for k in kinds)}")


def _feature(df: DataFrame, name: str) -> Value | Sequence:
    return Features.of(df.select(name).schema)[name]

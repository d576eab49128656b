"""Queries through Dataset, its features and samplers, and of arrays as images, series and batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomset.dataset import Dataset, concatenate
from loomset.features import ArrayND, ClassLabel, Features, Image, Value, Video
from loomset.functions import collate, vision
from loomset.operators import frames, knn, ordering, relational
from loomset.operators.selection import POS
from loomset.plans.catalogue import query, table
from loomset.sources import writers


def _events(spark, sf, *columns):
    return Dataset.from_dataframe(table(spark, sf, "events").select("event_id", *columns), "event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE value > 50")
def q_dataset_filter(spark, sf):
    return _events(spark, sf, "value").filter("value > 50").df.select("event_id", F.col(POS).alias("pos"))


@query("SELECT event_id FROM events WHERE value > 50 AND event_type = 'view'")
def q_dataset_filter_batched(spark, sf):
    keep = lambda b: [v is not None and v > 50 and t == "view" for v, t in zip(b["value"], b["event_type"], strict=True)]
    return _events(spark, sf, "value", "event_type").filter(keep, batched=True).rows.select("event_id")


@query("""
WITH v AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events), s AS (SELECT event_id, (p - 10) // 7 AS q FROM v WHERE p >= 10 AND p < 500 AND (p - 10) % 7 = 0)
SELECT event_id, CAST(i.slot AS BIGINT) AS pos FROM (VALUES (0, 5), (1, 3), (2, 69), (3, 3)) i(slot, q) JOIN s USING (q)
""")
def q_dataset_slice_select(spark, sf):
    return _events(spark, sf)[10:500:7].select([5, 3, -1, 3]).df.select("event_id", F.col(POS).alias("pos"))


@query("SELECT event_id, p - 100 AS pos FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p BETWEEN 100 AND 163")
def q_dataset_select_run(spark, sf):
    """Successive indices are a range filter."""
    return _events(spark, sf).select(list(range(100, 164))).df.select("event_id", F.col(POS).alias("pos"))


@query("SELECT event_id AS id, upper(event_type) AS kind, row_number() OVER (ORDER BY event_id) - 1 AS twice FROM events")
def q_dataset_columns(spark, sf):
    ds = _events(spark, sf, "event_type", "value").remove_columns(["value"]).rename_column("event_id", "id").rename_column("no such", "other")
    ds = ds.map({"kind": "upper(event_type)"}, remove_columns=["event_type"])
    return ds.add_column("twice", F.col(POS)).df.select("id", "kind", "twice")


@query("SELECT r_regionkey, r_name, CAST(10 * (row_number() OVER (ORDER BY r_regionkey) - 1) AS BIGINT) AS extra FROM region")
def q_dataset_add_list(spark, sf):
    ds = Dataset.from_dataframe(table(spark, sf, "region"), "r_regionkey")
    return ds.add_column("extra", [10 * i for i in range(len(ds))]).df.select("r_regionkey", "r_name", "extra")


@query("SELECT p_partkey, CAST(p_size * 2 + (row_number() OVER (ORDER BY p_partkey) - 1) % 3 AS BIGINT) AS score FROM part")
def q_dataset_map_index(spark, sf):
    ds = Dataset.from_dataframe(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    return ds.map(lambda r, i: {"score": r["p_size"] * 2 + i % 3}, "score bigint", with_indices=True, remove_columns=["p_size"]).df.select("p_partkey", "score")


@query("SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn, k) - 1 AS pos FROM conversations, (VALUES (0), (1)) t(k)")
def q_dataset_map_expand(spark, sf):
    """A batched map that doubles each row; rows are numbered anew."""
    ds = Dataset.from_dataframe(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    twice = lambda b: {c: [x for x in b[c] for _ in range(2)] for c in ("conv_id", "turn", "role")}
    return ds.map(twice, "conv_id bigint, turn bigint, role string", batched=True).df.select("conv_id", "turn", "role", F.col(POS).alias("pos"))


@query("SELECT n_nationkey, n_name, strlen(n_name) AS size, n_nationkey % 2 = 0 AS even, n_nationkey / 4.0::DOUBLE AS quarter FROM nation")
def q_dataset_map_inferred(spark, sf):
    """Types of new columns from the first row: whole numbers, booleans, floats."""
    ds = Dataset.from_dataframe(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return ds.map(lambda r: {"size": len(r["n_name"]), "even": r["n_nationkey"] % 2 == 0, "quarter": r["n_nationkey"] / 4.0}).df.drop(POS)


@query("""
WITH a AS (SELECT s_name AS name, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier), b AS (SELECT c_name AS name, c_mktsegment AS segment, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT name, NULL AS segment, pos FROM a UNION ALL SELECT name, segment, pos + (SELECT count(*) FROM a) FROM b
""")
def q_dataset_concatenate(spark, sf):
    a = Dataset.from_dataframe(table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey").remove_columns("s_suppkey")
    b = Dataset.from_dataframe(table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), "c_custkey").remove_columns("c_custkey")
    return concatenate([a, b]).df.select("name", "segment", F.col(POS).alias("pos"))


@query("""
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events), s AS (SELECT event_id FROM p ORDER BY md5('9:' || p), p LIMIT 100)
SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM s
""")
def q_dataset_sample(spark, sf):
    return _events(spark, sf).sample(100, 9).df.select("event_id", F.col(POS).alias("pos"))


@query("""
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events), s AS (SELECT event_id, row_number() OVER (ORDER BY md5('4:' || p), p) - 1 AS p FROM p)
SELECT event_id, p >= CAST(floor((SELECT count(*) FROM events) * 0.8) AS BIGINT) AS is_test FROM s
""")
def q_dataset_split(spark, sf):
    parts = _events(spark, sf).train_test_split(0.2, 4)
    return parts["train"].df.select("event_id", F.lit(False).alias("is_test")).unionByName(parts["test"].df.select("event_id", F.lit(True).alias("is_test")))


@query("SELECT event_id, value, row_number() OVER (ORDER BY md5('8:' || p), p) - 1 AS row_id FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events WHERE value < 30)")
def q_flatten_view(spark, sf):
    """A filtered, permuted view is written out and opened again."""
    path = f"{writers.scratch(spark, 'view')}/table"
    _events(spark, sf, "value").filter("value < 30").shuffle(8).write(path)
    return Dataset.open(spark, path).df.select("event_id", "value", F.col(POS).alias("row_id"))


_ORDERS = """
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events)
SELECT event_id, row_number() OVER (ORDER BY {key}) - 1 AS "order" FROM p {where}
"""


@query(_ORDERS.format(key="md5('3001:' || (p // 500)), p // 500, md5('3001:' || p), p", where=""))
def q_sampler_shards(spark, sf):
    it = _events(spark, sf).as_iterable(ordering.Sampler("shard_shuffle", seed=1, shard_rows=500))
    it.set_epoch(3)
    return it.frame().select("event_id", "order")


@query(_ORDERS.format(key="md5('1007:' || p), p", where=""))
def q_sampler_random(spark, sf):
    it = _events(spark, sf).as_iterable(ordering.Sampler("random", seed=7))
    it.set_epoch(1)
    return it.frame().select("event_id", "order")


@query(_ORDERS.format(key="p // 300, md5('5:' || p), p", where="WHERE (p // 100) % 3 = 2"))
def q_iterable_worker(spark, sf):
    return _events(spark, sf).as_iterable(ordering.Sampler("buffer", seed=5, shard_rows=100, buffer=300), worker=2, workers=3).frame().select("event_id", "order")


@query("SELECT r_regionkey, upper(r_name) AS shown FROM region")
def q_dataset_transform(spark, sf):
    """A transform sees rows as they come out, on the driver: for what a trainer reads, here five rows."""
    ds = Dataset.from_dataframe(table(spark, sf, "region"), "r_regionkey").with_transform(lambda r: (r["r_regionkey"], r["r_name"].upper()))
    return spark.createDataFrame(list(ds), "r_regionkey int, shown string")


@query("SELECT r_regionkey, r_name FROM region")
def q_dataset_batches(spark, sf):
    """Batches in the arrow format, and the whole table."""
    ds = Dataset.from_dataframe(table(spark, sf, "region"), "r_regionkey").with_format("arrow")
    batches = pa.concat_tables(ds.iter_batches(2))
    if not batches.equals(ds.to_arrow()):
        raise ValueError("batches and table differ")
    return spark.createDataFrame(batches)


# ---- features

_CLASSES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("SELECT r_name, CAST(list_position(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], r_name) - 1 AS BIGINT) AS code, r_name AS back, 'loomset' AS kept FROM region")
def q_feature_labels(spark, sf):
    """Codes, names again, and logical types that the schema keeps through a write."""
    label = ClassLabel(_CLASSES)
    path = f"{writers.scratch(spark, 'labels')}/table"
    rows = table(spark, sf, "region").select("r_name", label.encoded(F.col("r_name")).alias("code"))
    features = Features({"r_name": Value("string"), "code": label})
    Dataset.from_dataframe(rows, "r_name", features=features).write(path)
    ds = Dataset.open(spark, path, features)
    kept = "loomset" if Features.of(ds.df.select("code").schema)["code"] == label else "lost"
    return ds.df.select("r_name", "code", label.decoded(F.col("code")).alias("back"), F.lit(kept).alias("kept"))


@query("SELECT vec_id, CAST(256 AS BIGINT) AS n_bytes, CAST(embedding[10] AS DOUBLE) AS x FROM embeddings")
def q_feature_arrays(spark, sf):
    """Arrays of a fixed shape as bytes and back, encoded in tasks."""
    kind = ArrayND((8, 8, 1), "float32")

    @F.arrow_udf("binary")
    def encode(v: pa.Array) -> pa.Array:
        return pa.array([kind.encode(np.array(x).reshape(8, 8, 1)) for x in v.to_pylist()], pa.binary())

    @F.arrow_udf("double")
    def pick(raw: pa.Array) -> pa.Array:
        return pa.array([float(kind.decode(x)[1, 1, 0]) for x in raw.to_pylist()], pa.float64())

    e = table(spark, sf, "embeddings").select("vec_id", encode("embedding").alias("raw"))
    return e.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), pick("raw").alias("x"))


@query("SELECT doc_id, 'video/webm' AS media_type, CAST(strlen(text) AS BIGINT) AS size, 'sha256:' || sha256(text) AS checksum FROM documents WHERE text IS NOT NULL")
def q_feature_video_bytes(spark, sf):
    """A text's bytes stand in for a video's."""
    kind = Video("bytes", (".webm",))

    def run(batches):
        for b in batches:
            got = [kind.encode(t.encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[c] for g in got], t) for c, t in (("media_type", pa.string()), ("size", pa.int64()), ("checksum", pa.string())))], ["doc_id", "media_type", "size", "checksum"])

    return table(spark, sf, "documents").where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, media_type string, size bigint, checksum string")


@query("SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 50) + 128 AS BIGINT) for x in embedding[1:8]] AS row FROM embeddings")
def q_feature_images(spark, sf):
    """Grey images as PNG bytes, decoded again."""
    kind = Image()

    @F.arrow_udf("array<bigint>")
    def there_and_back(v: pa.Array) -> pa.Array:
        out = []
        for x in v.to_pylist():
            image = np.clip(np.floor(np.array(x, float) * 50) + 128, 0, 255).astype(np.uint8).reshape(8, 8)
            out.append(kind.decode(kind.encode(image))[0].tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return table(spark, sf, "embeddings").select("vec_id", there_and_back(F.col("embedding").cast("array<double>")).alias("row"))


@query("SELECT o_orderkey, TRY_CAST(o_orderpriority[1:1] AS BIGINT) AS level, CAST(o_totalprice AS VARCHAR) IS NOT NULL AS priced, TRY_CAST(o_orderstatus AS DOUBLE) AS number FROM orders")
def q_scalar_coercion(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("long").alias("level"), F.col("o_totalprice").cast("string").isNotNull().alias("priced"), F.col("o_orderstatus").try_cast("double").alias("number"))


# ---- arrays as images and series


def _on_images(spark, sf, f, kind="array<double>"):
    @F.arrow_udf(kind)
    def run(v: pa.Array) -> pa.Array:
        return pa.array([np.asarray(f(np.array(x, float).reshape(8, 8, 1))).ravel().astype(float).tolist() for x in v.to_pylist()], pa.list_(pa.float64()))

    return table(spark, sf, "embeddings").select("vec_id", run(F.col("embedding").cast("array<double>")).alias("x"))


_E = "CAST(embedding[{}] AS DOUBLE)"


@query("SELECT vec_id, [" + ", ".join(_E.format(8 * (4 + i // 4) + i % 4 + 1) for i in range(16)) + "] AS x FROM embeddings")
def q_image_patches(spark, sf):
    """The third patch of four, row by row."""
    return _on_images(spark, sf, lambda a: vision.patches(a, 4)[2])


@query("SELECT vec_id, [" + ", ".join("round((" + " + ".join(_E.format(8 * (2 * (i // 4) + y) + 2 * (i % 4) + x + 1) for y in (0, 1) for x in (0, 1)) + ") / 4, 5)" for i in range(16)) + "] AS x FROM embeddings")
def q_image_resize(spark, sf):
    return _on_images(spark, sf, lambda a: vision.resize(a, 4, 4).round(5))


@query("SELECT vec_id, [" + ", ".join(_E.format(8 * (2 + i // 4) + 2 + i % 4 + 1) for i in range(16)) + "] AS x FROM embeddings")
def q_image_crop(spark, sf):
    return _on_images(spark, sf, lambda a: vision.crop(a, 4, 4))


@query("SELECT vec_id, [" + ", ".join(_E.format(32 * (i % 32 // 16) + 16 * (i // 32) + i % 16 + 1) for i in range(64)) + "] AS x FROM embeddings")
def q_frame_layout(spark, sf):
    """Two frames of four by four with two channels, from frames first to channels first."""
    return _on_images(spark, sf, lambda a: vision.to_layout(np.stack([np.stack([a.ravel()[32 * t + 16 * c : 32 * t + 16 * c + 16].reshape(4, 4) for c in (0, 1)], -1) for t in (0, 1)]), "CTHW"))


@query("WITH f AS (SELECT vec_id, [floor(CAST(x AS DOUBLE) * 50) + 128 for x in embedding] AS f FROM embeddings) SELECT vec_id, CAST(list_sum(f) AS DOUBLE) AS before, true AS one_patch, 255.0::DOUBLE AS both FROM f")
def q_image_invert_patch(spark, sf):
    """A patch of 3 by 3 is inverted at a place that the row decides: nine bytes change at most, each to its complement."""

    @F.arrow_udf("struct<before:double,one_patch:boolean,both:double>")
    def run(k: pa.Array, v: pa.Array) -> pa.Array:
        out = []
        for row, x in zip(k.to_pylist(), v.to_pylist(), strict=True):
            a = (np.floor(np.array(x, float) * 50) + 128).astype(np.uint8).reshape(8, 8)
            b = vision.inverted_patch(a, row, 3)
            ys, xs = np.nonzero(a != b)
            out.append({"before": float(a.sum()), "one_patch": len(ys) == 9 and int(np.ptp(ys)) == 2 and int(np.ptp(xs)) == 2, "both": float((a.astype(int) + b)[a != b].mean())})
        return pa.array(out, pa.struct([("before", pa.float64()), ("one_patch", pa.bool_()), ("both", pa.float64())]))

    return table(spark, sf, "embeddings").select("vec_id", run("vec_id", F.col("embedding").cast("array<double>")).alias("r")).select("vec_id", "r.*")


@query("WITH t AS (SELECT conv_id, list(CASE WHEN turn % 3 = 0 THEN 0 ELSE strlen(text) END ORDER BY turn) AS n FROM conversations GROUP BY 1) SELECT conv_id, [coalesce(n[i], 0) for i in range(1, 7)] AS n FROM t")
def q_series_reindex(spark, sf):
    """Cut or filled up to six, missing values as nought."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 != 0, F.octet_length("text")).alias("n")))).alias("s"))
    return c.select("conv_id", frames.padded(F.transform("s", lambda x: F.coalesce(x["n"].cast("long"), F.lit(0))), 6, 0).alias("n"))


@query("SELECT event_id, [CAST(x AS INTEGER) for x in string_split(CAST(event_id AS VARCHAR) || ' ' || user_id, ' ')] AS numbers FROM events")
def q_element_casts(spark, sf):
    return table(spark, sf, "events").select("event_id", F.split(F.concat_ws(" ", F.col("event_id").cast("string"), F.col("user_id").cast("string")), " ").cast("array<int>").alias("numbers"))


@query("""
WITH t AS (SELECT conv_id, list(strlen(text) ORDER BY turn) AS n FROM conversations GROUP BY 1), b AS (SELECT conv_id // 8 AS batch, max(len(n)) AS longest FROM t GROUP BY 1)
SELECT conv_id, [CAST(coalesce(n[i], 0) AS DOUBLE) for i in range(1, longest + 1)] AS series, [i <= len(n) for i in range(1, longest + 1)] AS mask FROM t JOIN b ON b.batch = t.conv_id // 8
""")
def q_collate_batches(spark, sf):
    """Series padded to the longest of their batch, with masks; a batch is eight successive ids."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.octet_length("text").alias("n")))), lambda x: x["n"]).alias("s"))

    def run(t: pa.Table) -> pa.Table:
        rows = [{"series": s, "label": k} for k, s in zip(t["conv_id"].to_pylist(), t["s"].to_pylist(), strict=True)]
        out = collate.pad_series(rows)
        return pa.table({"conv_id": pa.array(out["label"]), "series": pa.array(out["series"][:, :, 0].astype(float).tolist(), pa.list_(pa.float64())), "mask": pa.array(out["mask"].tolist(), pa.list_(pa.bool_()))})

    return c.groupBy(F.floor(F.col("conv_id") / 8).alias("batch")).applyInArrow(run, "conv_id bigint, series array<double>, mask array<boolean>")


# ---- analytics of runs

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


@query(f"SELECT event_id, {_ISO} AS iso, CAST(date_part('year', ts) AS INTEGER) AS year FROM events")
def q_iso_timestamps(spark, sf):
    """Written as ISO text and parsed again."""
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))
    return e.select("event_id", "iso", F.year(F.to_timestamp_ntz("iso", F.lit("yyyy-MM-dd'T'HH:mm:ss"))).alias("year"))


@query("SELECT conv_id, '{\"turn\":' || turn || ',\"role\":\"' || role || '\"}' AS record FROM conversations")
def q_json_encode(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", F.to_json(F.struct("turn", "role")).alias("record"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'F', o_totalprice * 2 FROM orders WHERE o_orderstatus = 'P'")
def q_replace_masked(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    mask = F.col("o_orderstatus") == "P"
    return relational.replaced(o, mask, o.where(mask).select("o_orderkey", F.lit("F").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice")))


@query("SELECT page_id, CAST(page_id AS VARCHAR) || '.txt' AS note, strlen(html) AS n_bytes FROM pages")
def q_join_derived_path(spark, sf):
    """Files joined by stem: a page's html file and its note."""
    p = table(spark, sf, "pages")
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.\w+$", 1)
    left = p.select("page_id", F.concat(F.lit("a/b/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.octet_length("html").cast("long").alias("n_bytes"))
    right = p.select(F.concat(F.lit("notes/"), F.col("page_id").cast("string"), F.lit(".txt")).alias("at"))
    joined = relational.join_all(left.withColumn("stem", stem("path")), right.withColumn("stem", stem("at")), "stem")
    return joined.select("page_id", F.element_at(F.split("at", "/"), -1).alias("note"), "n_bytes")


@query("""
WITH d(name, setting) AS (VALUES ('lr', '0.1'), ('epochs', '50'), ('seed', '0')), o AS (SELECT n_name AS dataset, 'epochs' AS name, CAST(n_nationkey AS VARCHAR) AS setting FROM nation UNION ALL SELECT n_name, 'warmup', '5' FROM nation WHERE n_regionkey = 1),
k AS (SELECT DISTINCT dataset FROM o), g AS (SELECT dataset, name, setting AS s FROM k, d)
SELECT dataset, name, coalesce(o.setting, g.s) AS setting FROM g FULL JOIN o USING (dataset, name)
""")
def q_config_overlay(spark, sf):
    n = table(spark, sf, "nation")
    defaults = spark.createDataFrame([("lr", "0.1"), ("epochs", "50"), ("seed", "0")], "name string, setting string")
    own = n.select(F.col("n_name").alias("dataset"), F.lit("epochs").alias("name"), F.col("n_nationkey").cast("string").alias("setting")).unionByName(n.where("n_regionkey = 1").select(F.col("n_name").alias("dataset"), F.lit("warmup").alias("name"), F.lit("5").alias("setting")))
    return relational.overlaid(defaults, own, ["dataset"], "name", "setting")


@query("SELECT user_id, max(value) AS peak, arg_max(event_id, (value, -event_id)) AS at FROM events WHERE value IS NOT NULL GROUP BY user_id")
def q_peak_samples(spark, sf):
    """The peak of samples over time, and the first sample that reaches it."""
    e = table(spark, sf, "events").where("value is not null")
    return e.groupBy("user_id").agg(F.max("value").alias("peak"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("at"))


@query("""
WITH p AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, b.label AS l, a.label AS own, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, neighbour) AS rank FROM p),
v AS (SELECT key, own, l, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, l) AS r FROM n WHERE rank <= 10 GROUP BY key, own, l),
h AS (SELECT key, own, max(CASE WHEN own = l THEN 1.0 ELSE 0 END) AS hit FROM v WHERE r <= 5 GROUP BY ALL), a AS (SELECT own, avg(hit) AS a, count(*) AS n FROM h GROUP BY own)
SELECT round(avg(a), 6) AS macro_accuracy, round(sum(a * n) / sum(n), 6) AS accuracy FROM a
""")
def q_knn_top5_accuracy(spark, sf):
    e = table(spark, sf, "embeddings")
    a = knn.top_accuracy(knn.neighbours(e, "vec_id", "embedding", 10), e, "vec_id", "label", 5)
    return a.select(F.round("macro_accuracy", 6).alias("macro_accuracy"), F.round("accuracy", 6).alias("accuracy"))


@query("WITH v AS (SELECT generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS a, vec_id FROM embeddings) SELECT CAST(x.i AS INTEGER) AS i, CAST(y.i AS INTEGER) AS j, round(sum(x.a * y.a), 4) AS x FROM v x JOIN v y ON x.vec_id = y.vec_id AND x.i <= y.i GROUP BY ALL")
def q_gram_matrix(spark, sf):
    """What the effective rank is computed from."""
    return knn.gram(table(spark, sf, "embeddings"), "embedding").select("i", "j", F.round("x", 4).alias("x"))


@query()
def q_lidar(spark, sf):
    return spark.createDataFrame([(round(knn.lidar(table(spark, sf, "embeddings"), "embedding", "label"), 4),)], "lidar double")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'train' WHEN quality = 0 THEN 'test' ELSE 'validation' END AS split FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality IN (0, 1)")
def q_split_membership(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    split = {"train": "quality = 1", "test": "quality = 0", "validation": "quality is null"}
    parts = [d.where(test).select("doc_id", F.lit(name).alias("split")) for name, test in split.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


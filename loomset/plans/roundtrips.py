"""Queries of sources and sinks: tables go out as raw files, written by tasks, and come back through the readers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomset import storage
from loomset.plans.catalogue import query, table
from loomset.sources import archives, arrow_ipc, sinks, writers

_PAGES = "SELECT page_id, CAST(strlen(html) AS BIGINT) AS n_bytes, sha256(html) AS digest FROM pages"


def _pages_in(spark, sf, write, suffix, depth=0):
    folder = writers.scratch(spark, "pages")
    pages = table(spark, sf, "pages").select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("member"), "html")
    writers.by_task(pages.repartition(4), folder, suffix, write)
    found = archives.archive(spark, folder, depth=depth)
    return found.select(F.regexp_extract("member", r"(\d+)\.html$", 1).cast("long").alias("page_id"), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


@query(_PAGES)
def q_zip_members(spark, sf):
    return _pages_in(spark, sf, writers.zip_members, ".zip")


@query(_PAGES)
def q_tar_members(spark, sf):
    return _pages_in(spark, sf, writers.tar_members, ".tar.gz")


@query(_PAGES)
def q_nested_members(spark, sf):
    return _pages_in(spark, sf, writers.nested_members, ".tar", depth=1)


@query("SELECT page_id, CAST(page_id % 4 AS VARCHAR) AS label, sha256(html) AS digest FROM pages")
def q_class_tree(spark, sf):
    folder = writers.scratch(spark, "tree")
    rows = table(spark, sf, "pages").select(F.concat_ws("/", F.lit("train"), (F.col("page_id") % 4).cast("string"), F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("at"), "html")
    writers.by_task(rows, folder, "", writers.tree(folder))
    return archives.folder(spark, folder, "*.html").select(F.regexp_extract("path", r"(\d+)\.html$", 1).cast("long").alias("page_id"), "label", F.sha2("content", 256).alias("digest"))


def _numbers(kind: str):
    """An arrow function of items' bytes: their elements as doubles."""

    @F.arrow_udf("array<double>")
    def read(content: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(c, kind).astype(float).tolist() for c in content.to_pylist()], pa.list_(pa.float64()))

    return read


def _stem():
    return F.regexp_extract("path", r"(part-\d+)", 1).alias("stem")


def _embedded(spark, sf, make, suffix, kind="float32"):
    """Matrices of embeddings in files of one format, beside files of the ids of the same stem.

    Both are written by jobs of their own, and rows come out of a shuffle in any order: they are sorted, so that places agree.
    """
    folder = writers.scratch(spark, "arrays")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding").repartition(3, "vec_id").sortWithinPartitions("vec_id")
    writers.by_task(e, folder, suffix, writers.arrays(make))
    writers.by_task(e, folder, ".ids.npy", writers.arrays(lambda ids, x: writers.npy_bytes(ids)))
    ids = archives.array_rows(spark, folder, archives.parse_npy, "*.ids.npy").select(_stem(), "idx", _numbers("int64")("content")[0].cast("long").alias("vec_id"))
    return folder, ids, lambda parse, name: archives.array_rows(spark, folder, parse, name).select(_stem(), "idx", "shape", _numbers(kind)("content").alias("x"))


_ENDS = "SELECT vec_id, 64 AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings"


def _ends(ids, items):
    return ids.join(items, ["stem", "idx"]).select("vec_id", F.size("x").alias("n"), F.col("x")[0].alias("first"), F.element_at("x", -1).alias("last"))


@query(_ENDS)
def q_npy_items(spark, sf):
    _, ids, items = _embedded(spark, sf, lambda ids, x: writers.npy_bytes(x), ".x.npy")
    return _ends(ids, items(archives.parse_npy, "*.x.npy"))


@query(_ENDS)
def q_npz_items(spark, sf):
    folder = writers.scratch(spark, "npz")
    writers.by_task(table(spark, sf, "embeddings").select("vec_id", "embedding").repartition(3), folder, ".npz", writers.arrays(lambda ids, x: writers.npz_bytes(ids=ids, images=x)))
    rows = archives.array_rows(spark, folder, archives.parse_npy, "*.npz")
    ids = rows.where("array = 'ids'").select(_stem(), "idx", _numbers("int64")("content")[0].cast("long").alias("vec_id"))
    return _ends(ids, rows.where("array = 'images'").select(_stem(), "idx", _numbers("float32")("content").alias("x")))


@query(_ENDS)
def q_idx_items(spark, sf):
    import gzip

    _, ids, items = _embedded(spark, sf, lambda ids, x: gzip.compress(writers.idx_bytes(x.astype(np.float32).reshape(-1, 8, 8))), ".idx.gz")
    return _ends(ids, items(archives.parse_idx, "*.idx.gz"))


@query(_ENDS)
def q_matrix_items(spark, sf):
    _, ids, items = _embedded(spark, sf, lambda ids, x: writers.matrix_bytes(x.astype(np.float32)), ".mat")
    return _ends(ids, items(archives.parse_matrix, "*.mat"))


@query("SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 50) + 128 AS BIGINT) for x in embedding[1:8]] AS row FROM embeddings")
def q_column_major_items(spark, sf):
    """Bytes stored column by column come back row by row."""
    make = lambda ids, x: np.clip(np.floor(x.astype(float) * 50) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).tobytes()
    _, ids, items = _embedded(spark, sf, make, ".bin", "uint8")
    got = items(lambda data: archives.parse_columns(data, (8, 8)), "*.bin")
    return ids.join(got, ["stem", "idx"]).select("vec_id", F.slice("x", 1, 8).cast("array<bigint>").alias("row"))


@query("SELECT vec_id, 16000 AS rate, CAST(64 AS BIGINT) AS n, CAST(list_sum([floor(CAST(x AS DOUBLE) * 1000) for x in embedding]) AS DOUBLE) AS total FROM embeddings")
def q_wav_sounds(spark, sf):
    folder = writers.scratch(spark, "wav")
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")))
    writers.by_task(rows.repartition(3), folder, ".zip", writers.wav_archive)
    s = archives.sounds(archives.archive(spark, folder), "member")
    total = F.aggregate("series", F.lit(0.0), lambda a, x: a + x[0].cast("double"))
    return s.select(F.regexp_extract("path", r"(\d+)\.wav", 1).cast("long").alias("vec_id"), "rate", F.size("series").cast("long").alias("n"), total.alias("total"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def q_delimited_table(spark, sf):
    folder = writers.scratch(spark, "delimited")
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.mode("overwrite").option("header", True).option("sep", ";").csv(f"file://{folder}")
    return archives.delimited(spark, f"file://{folder}").select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_acctbal").cast("double"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def q_csv_results(spark, sf):
    """Result files of several runs, found by pattern and put together; an empty result is an error."""
    folder = writers.scratch(spark, "results")
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).write.option("header", True).csv(f"file://{folder}/run-{part}")
    got = archives.delimited(spark, f"file://{folder}/run-*", ",")
    if got.isEmpty():
        raise ValueError("no results")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))


@query("SELECT conv_id, turn, role FROM conversations")
def q_json_list(spark, sf):
    folder = writers.scratch(spark, "json")

    def write(path, batches):
        import json

        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            with open(path, "w") as f:
                json.dump(rows, f)
        return len(rows)

    writers.by_task(table(spark, sf, "conversations").select("conv_id", "turn", "role").repartition(4), folder, ".json", write)
    return archives.json_records(spark, f"file://{folder}", "conv_id bigint, turn bigint, role string")


@query("SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def q_json_dict(spark, sf):
    folder = writers.scratch(spark, "dict")
    one = table(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string"))))).alias("value"))
    one.write.mode("overwrite").text(f"file://{folder}")
    return archives.json_entries(spark, f"file://{folder}")


_SERIES = "SELECT vec_id, 2 AS dims, 32 AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings"


@query(_SERIES)
def q_ts_series(spark, sf):
    folder = writers.scratch(spark, "series")
    half = lambda a: F.array_join(F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double").cast("string")), ",")
    lines = table(spark, sf, "embeddings").select(F.concat_ws(":", half(1), half(33), F.col("vec_id").cast("string")).alias("line"))

    def write(path, batches):
        n = 0
        with open(path, "w") as f:
            f.write("# made of vectors\n@problemName vectors\n@timeStamps false\n@univariate false\n@classLabel true any\n@data\n")
            for b in batches:
                f.writelines(f"{x}\n" for x in b.column(0).to_pylist())
                n += b.num_rows
        return n

    writers.by_task(lines, folder, ".ts", write)
    s = archives.time_series(spark, f"file://{folder}")
    return s.select(F.col("label").cast("long").alias("vec_id"), F.size("series").alias("dims"), F.size(F.col("series")[0]).alias("n"), F.col("series")[0][0]["value"].alias("first"), F.col("series")[1][31]["value"].alias("last"))


@query("SELECT vec_id, 64 AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def q_arff_rows(spark, sf):
    folder = writers.scratch(spark, "arff")
    lines = table(spark, sf, "embeddings").select(F.concat(F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ","), F.lit(",'"), F.col("vec_id").cast("string"), F.lit("'")).alias("line"))

    def write(path, batches):
        n = 0
        with open(path, "w") as f:
            f.write("% made of vectors\n@relation vectors\n@attribute a numeric\n@data\n")
            for b in batches:
                f.writelines(f"{x}\n" for x in b.column(0).to_pylist())
                n += b.num_rows
        return n

    writers.by_task(lines, folder, ".arff", write)
    return archives.arff(spark, f"file://{folder}").select(F.col("label").cast("long").alias("vec_id"), F.size("values").alias("n"), F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def q_arrow_shards(spark, sf):
    folder = writers.scratch(spark, "ipc")
    writers.by_task(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").repartition(4), folder, ".arrow", writers.arrow_shard)
    arrow_ipc.register(spark)
    return spark.read.format("arrow_shards").load(folder)


_WIDTH = "strlen(CAST(doc_id AS VARCHAR)) + coalesce(strlen(source), 0) + strlen(CAST(n_chars AS VARCHAR))"
_GREEDY = """
WITH RECURSIVE r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents),
b AS (SELECT row_id // {size} AS batch, CAST(sum({width}) AS BIGINT) AS b, count(*) AS n FROM r GROUP BY 1),
s(batch, shard, filled) AS (
  SELECT batch, CAST(0 AS BIGINT), b FROM b WHERE batch = 0
  UNION ALL
  SELECT b.batch, s.shard + CASE WHEN s.filled >= {target} THEN 1 ELSE 0 END, CASE WHEN s.filled >= {target} THEN 0 ELSE s.filled END + b.b FROM s JOIN b ON b.batch = s.batch + 1)
"""


@query(_GREEDY.format(size=50, width=_WIDTH, target=4000) + "SELECT doc_id, source, n_chars, CAST(row_id AS BIGINT) AS row_id, shard FROM r JOIN s ON s.batch = r.row_id // 50")
def q_sharded_table(spark, sf):
    """Written in shards of about 4000 bytes, opened by its manifest."""
    path = f"{writers.scratch(spark, 'sharded')}/table"
    storage.write(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), path, order=["doc_id"], batch_size=50, shard_bytes=4000)
    return storage.open_table(spark, path).select("doc_id", "source", "n_chars", F.col(storage.ROW).alias("row_id"), F.col(storage.SHARD).cast("long").alias("shard"))


@query(_GREEDY.format(size=50, width=_WIDTH, target=4000) + ", c AS (SELECT shard, CAST(sum(n) AS BIGINT) AS n FROM s JOIN b USING (batch) GROUP BY shard) SELECT shard, n, (SELECT count(*) FROM documents) AS num_rows, (SELECT count(*) FROM c) AS num_shards FROM c")
def q_manifest_counts(spark, sf):
    path = f"{writers.scratch(spark, 'manifest')}/table"
    storage.write(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), path, order=["doc_id"], batch_size=50, shard_bytes=4000)
    m = storage.manifest_of(path)
    return spark.createDataFrame([(i, n, m["num_rows"], m["num_shards"]) for i, n in enumerate(m["shard_row_counts"])], "shard bigint, n bigint, num_rows bigint, num_shards bigint")


@query(_GREEDY.format(size=50, width="strlen(text)", target=1 << 18) + "SELECT shard, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(b) AS BIGINT) AS n_bytes FROM s JOIN b USING (batch) GROUP BY shard")
def q_greedy_shards(spark, sf):
    from loomset.operators import selection

    d = selection.with_positions(table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("b")), "doc_id")
    sizes = d.groupBy(F.floor(F.col(selection.POS) / 50).alias("batch")).agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    return storage.shard_of_batches(sizes, 1 << 18).groupBy("shard").agg(F.sum("n").alias("n_rows"), F.sum("b").alias("n_bytes"))


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey DESC) - 1 AS row_id FROM part")
def q_row_layout(spark, sf):
    path = f"{writers.scratch(spark, 'rows')}/table"
    storage.write(table(spark, sf, "part").select("p_partkey", "p_name"), path, order=[F.desc("p_partkey")])
    return storage.open_table(spark, path).select("p_partkey", "p_name", F.col(storage.ROW).alias("row_id"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def q_append_checked(spark, sf):
    path = f"{writers.scratch(spark, 'append')}/table"
    r = table(spark, sf, "region")
    sinks.append_checked(r, path)
    sinks.append_checked(r.select((F.col("r_regionkey") + 100).cast(r.schema["r_regionkey"].dataType).alias("r_regionkey"), "r_name"), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey, n_name FROM nation")
def q_csv_report(spark, sf):
    path = f"{writers.scratch(spark, 'report')}/nations.csv"
    sinks.csv_report(table(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.option("header", True).csv(f"file://{path}").select(F.col("n_nationkey").cast("int"), "n_name")


@query("SELECT CAST(doc_id AS INTEGER) AS video_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS frame_idx, strlen(unnest(string_split(text, chr(10)))) AS n_bytes FROM documents")
def q_frame_explode(spark, sf):
    """A text stands in for a video, its lines for frames."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return sinks.frame_table(d, lambda data: data.split(b"\n"), "doc_id").select("video_id", "frame_idx", F.octet_length("bytes").cast("long").alias("n_bytes"))


@query("""
WITH n AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY 1), w AS (SELECT conv_id, CAST(unnest(generate_series(0, n - 3, 2)) AS INTEGER) AS start_frame FROM n WHERE n >= 3),
s AS (SELECT *, row_number() OVER (ORDER BY conv_id, start_frame) - 1 AS sample_idx FROM w)
SELECT conv_id, start_frame, array_to_string([start_frame, start_frame + 1, start_frame + 2], ',') AS frame_indices, string_agg(role || ':' || strlen(text), ',' ORDER BY turn) AS frames, CAST(sample_idx AS BIGINT) AS sample_idx
FROM s JOIN conversations USING (conv_id) WHERE turn BETWEEN start_frame AND start_frame + 2 GROUP BY ALL
""")
def q_frame_windows(spark, sf):
    """A stored frame table, opened as windows of three turns, every second start."""
    path = f"{writers.scratch(spark, 'frames')}/table"
    c = table(spark, sf, "conversations")
    storage.write_frames(c.select("conv_id", "turn", "role", "text"), c.select("conv_id").distinct(), path, "conv_id", "turn")
    w = storage.open_windows(spark, path, 3, hop=2)
    shown = F.array_join(F.transform("frames", lambda f: F.concat(f["role"], F.lit(":"), F.octet_length(f["text"]).cast("string"))), ",")
    return w.select("conv_id", "start_frame", F.array_join(F.col("frame_indices").cast("array<string>"), ",").alias("frame_indices"), shown.alias("frames"), "sample_idx")


@query("WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, n AS n_frames, CAST(coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_row FROM n")
def q_frame_manifest(spark, sf):
    return sinks.frame_manifest(table(spark, sf, "conversations").select(F.col("conv_id").alias("video_id"))).withColumnRenamed("video_id", "conv_id")



"""Queries of projections, column mutation, maps, arrays, strings and hashes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from loomset.operators import frames, relational, selection
from loomset.plans.catalogue import query, table


@query("""
WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation), s AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier)
SELECT n_nationkey, s_name FROM n JOIN s USING (p)
""")
def q_add_column_positional(spark, sf):
    n = selection.with_positions(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey")
    s = selection.with_positions(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return n.join(s, selection.POS).select("n_nationkey", "s_name")


@query("SELECT p_partkey, upper(p_brand) AS brand, round(p_retailprice * 1.1, 4) AS price, p_size % 7 AS bin FROM part")
def q_map_row(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.upper("p_brand").alias("brand"), F.round(F.col("p_retailprice") * 1.1, 4).alias("price"), (F.col("p_size") % 7).alias("bin"))


@query("SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents")
def q_map_batched_expand(spark, sf):
    def lines(batches):
        for b in batches:
            ids, nos, out = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = t.split("\n")
                ids += [i] * len(parts)
                nos += range(len(parts))
                out += parts
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), pa.array(out, pa.string())], ["doc_id", "line_no", "line"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInArrow(lines, "doc_id bigint, line_no bigint, line string")


@query("SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS idx FROM region")
def q_map_with_index(spark, sf):
    return selection.with_positions(table(spark, sf, "region"), "r_regionkey", name="idx").select("r_name", "idx")


@query("SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(4)) + " FROM embeddings")
def q_vector_unpack(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(4)])


@query("""
WITH s AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings), m AS (SELECT vec_id, e, list_avg(e) AS m FROM s),
d AS (SELECT vec_id, e, m, greatest(sqrt(list_avg([(x - m) * (x - m) for x in e])), 1e-6) AS d FROM m)
SELECT vec_id, round(list_sum([abs((x - m) / d) for x in e]), 4) AS spread FROM d
""")
def q_vector_normalise(spark, sf):
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("m", mean(F.col("e")))
    v = v.withColumn("d", F.greatest(F.sqrt(mean(F.transform("e", lambda x: (x - F.col("m")) * (x - F.col("m"))))), F.lit(1e-6)))
    return v.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + F.abs((x - F.col("m")) / F.col("d"))), 4).alias("spread"))


@query("""
WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS a FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, len(a) AS n, list_resize(a, 8, 0) AS a FROM c)
SELECT conv_id, CAST(n AS BIGINT) AS valid, array_to_string(a, ',') AS padded FROM p
""")
def q_pad_clip_mask(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda s: s["n"]).alias("a"))
    return c.select("conv_id", F.size("a").cast("long").alias("valid"), F.array_join(frames.padded(F.col("a"), 8, 0).cast("array<string>"), ",").alias("padded"))


@query("""
WITH a AS (SELECT source, avg(quality) AS acc, avg(1 - toxic) AS sup FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, round((acc - 0.1) / 0.9, 6) AS z, round(CASE WHEN sup - 0.1 > 0 THEN (acc - 0.1) / (sup - 0.1) END, 6) AS r FROM a
""")
def q_norm_accuracy(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("acc"), F.avg(1 - F.col("toxic")).alias("sup"))
    return a.select("source", F.round((F.col("acc") - 0.1) / 0.9, 6).alias("z"), F.round(relational.normalised(F.col("acc"), F.lit(0.1), F.col("sup")), 6).alias("r"))


@query("SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN source END, lang || ':' || source) AS origin FROM documents")
def q_struct_coalesce(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.struct(F.when(F.col("lang") == "en", F.col("source")).alias("direct"), F.concat_ws(":", "lang", "source").alias("other")).alias("v"))
    return s.select("doc_id", F.coalesce("v.direct", "v.other").alias("origin"))


@query("SELECT vec_id, unnest([0, 1, 2, 3]) AS i, CAST(round(unnest(embedding[1:4]), 5) AS DOUBLE) AS x, CAST(round(unnest(embedding[5:8]), 5) AS DOUBLE) AS y FROM embeddings")
def q_zip_arrays(spark, sf):
    e = F.col("embedding").cast("array<double>")
    z = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(F.slice(e, 1, 4).alias("x"), F.slice(e, 5, 4).alias("y"))).alias("i", "p"))
    return z.select("vec_id", "i", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@query("SELECT vec_id, " + ", ".join(f"round(CAST(list_max(embedding[{8 * k + 1}:{8 * k + 8}]) AS DOUBLE), 6) AS block{k}" for k in range(8)) + " FROM embeddings")
def q_block_max(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return v.select("vec_id", *relational.block_max("e", [(8 * k, 8 * k + 8) for k in range(8)]))


@query("SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part")
def q_label_encode(spark, sf):
    return relational.dense_codes(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", "code").select("p_partkey", "p_type", "code")


@query("SELECT p_partkey, CASE WHEN p_size = 10 THEN 0 ELSE p_size END AS digit, p_size - 1 AS zero_based, CAST(least(greatest(p_size, 5), 40) AS INTEGER) AS clipped FROM part")
def q_value_remap(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.when(s == 10, 0).otherwise(s).alias("digit"), (s - 1).alias("zero_based"), F.least(F.greatest(s, F.lit(5)), F.lit(40)).alias("clipped"))


@query(r"""
SELECT page_id, string_split(url, '/')[-1] AS base, regexp_extract(url, '^https?://([^/]+)', 1) AS host, nullif(regexp_extract(url, '(\d+)$', 1), '') AS number,
  lower(translate(url, '/:', '__')) AS key, CAST(length(regexp_replace(url, '[^\p{L}]', '', 'g')) AS BIGINT) AS letters, url[-5:-5] AS fifth, lpad(CAST(page_id AS VARCHAR), 8, '0') AS padded,
  regexp_extract(url, '/(.*)/', 1) AS between FROM pages
""")
def q_string_suite(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        F.element_at(F.split(u, "/"), -1).alias("base"),
        F.regexp_extract(u, r"^https?://([^/]+)", 1).alias("host"),
        F.nullif(F.regexp_extract(u, r"(\d+)$", 1), F.lit("")).alias("number"),
        F.lower(F.translate(u, "/:", "__")).alias("key"),
        F.length(F.regexp_replace(u, r"[^\p{L}]", "")).cast("long").alias("letters"),
        F.substring(u, -5, 1).alias("fifth"),
        F.lpad(F.col("page_id").cast("string"), 8, "0").alias("padded"),
        F.regexp_extract(u, "/(.*)/", 1).alias("between"),
    )


@query("""
SELECT page_id, coalesce(CASE lower(nullif(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1), '')) WHEN 'html' THEN 'text/html' WHEN 'mp4' THEN 'video/mp4' WHEN 'com' THEN 'application/x-msdownload' END, 'application/octet-stream') AS media FROM pages
""".replace("\\\\", "\\"))
def q_media_type(spark, sf):
    ext = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for x in ("html", "text/html", "mp4", "video/mp4", "com", "application/x-msdownload")])
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream")).alias("media"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY sha256(text)")
def q_hash_dedupe(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT n_nationkey, substr(sha256('nation:1.0.0:' || n_name || ':train:parquet'), 1, 16) AS cache_key FROM nation")
def q_cache_key(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.substring(F.sha2(F.concat_ws(":", F.lit("nation"), F.lit("1.0.0"), "n_name", F.lit("train"), F.lit("parquet")), 256), 1, 16).alias("cache_key"))


@query("SELECT doc_id, md5(text) = md5(text || '') AS ok FROM documents")
def q_checksum_verify(spark, sf):
    from loomset.functions.hashing import verify

    d = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("md5:"), F.md5("text")).alias("sum"))
    return d.select("doc_id", verify(F.col("text"), F.col("sum")).alias("ok"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def q_json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT event_id, xor(user_id, 7) AS mixed, event_id // 3 AS third, event_id % 5 AS rest FROM events")
def q_integer_math(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("user_id").bitwiseXOR(F.lit(7)).alias("mixed"), F.floor(F.col("event_id") / 3).alias("third"), (F.col("event_id") % 5).alias("rest"))


_LENGTHS = "SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id"


def _lengths(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"WITH t AS ({_LENGTHS}) SELECT conv_id, CAST(unnest(generate_series(0, n - 3, 2)) AS INTEGER) AS start FROM t WHERE n >= 3")
def q_window_plan(spark, sf):
    return frames.plan_windows(_lengths(spark, sf), "conv_id", 3, hop=2)


@query(f"""
WITH t AS ({_LENGTHS}), w AS (SELECT conv_id, CAST(unnest(generate_series(0, n - 3, 2)) AS INTEGER) AS start FROM t WHERE n >= 3)
SELECT conv_id, start, string_agg(turn || ':' || role, ',' ORDER BY turn) AS payload FROM w JOIN conversations USING (conv_id) WHERE turn BETWEEN start AND start + 2 GROUP BY ALL
""")
def q_window_payload(spark, sf):
    w = frames.plan_windows(_lengths(spark, sf), "conv_id", 3, hop=2)
    p = frames.window_payload(w, table(spark, sf, "conversations"), "conv_id", "turn", F.concat_ws(":", F.col("turn").cast("string"), "role"), 3)
    return p.select("conv_id", "start", F.array_join("payload", ",").alias("payload"))


@query(f"WITH t AS ({_LENGTHS}) SELECT conv_id, array_to_string([CAST(round_even(i * (n - 1) / 3.0, 0) AS INTEGER) for i in range(4)], ',') AS idx FROM t WHERE n >= 4")
def q_frame_sampling_uniform(spark, sf):
    s = _lengths(spark, sf).select("conv_id", frames.sample_indices(F.col("n"), 4).alias("i"))
    return s.where("i is not null").select("conv_id", F.array_join(F.col("i").cast("array<string>"), ",").alias("idx"))


@query(f"WITH t AS ({_LENGTHS}) SELECT conv_id, array_to_string([(greatest(0, n - 3) // 2 + i) % n for i in range(3)], ',') AS idx FROM t")
def q_frame_sampling_center(spark, sf):
    s = _lengths(spark, sf).select("conv_id", frames.sample_indices(F.col("n"), 3, "center", pad="loop").alias("i"))
    return s.select("conv_id", F.array_join(F.col("i").cast("array<string>"), ",").alias("idx"))


@query(f"WITH t AS ({_LENGTHS}) SELECT conv_id, array_to_string([least(i * 2, n - 1) for i in range(4)], ',') AS idx FROM t")
def q_frame_sampling_start(spark, sf):
    s = _lengths(spark, sf).select("conv_id", frames.sample_indices(F.col("n"), 4, "start", stride=2, pad="repeat_last").alias("i"))
    return s.select("conv_id", F.array_join(F.col("i").cast("array<string>"), ",").alias("idx"))

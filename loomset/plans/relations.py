"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomset.operators import relational, selection
from loomset.plans.catalogue import query, table


@query("SELECT l_orderkey, l_linenumber - 1 AS line0, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def q_join_three_way(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    oc = o.join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(oc, "l_orderkey").select("l_orderkey", (F.col("l_linenumber") - 1).alias("line0"), "c_mktsegment")


@query("SELECT c_custkey, n_name AS nation_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_join_suffix_merge(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation_name"))
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey").select("c_custkey", "nation_name")


@query("""
WITH b AS (SELECT user_id, value AS base FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1)
SELECT event_id, round(CASE WHEN base > 0 THEN value / base END, 6) AS ratio FROM events LEFT JOIN b USING (user_id)
""")
def q_join_baseline_left(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    base = e.groupBy("user_id").agg(F.min_by("value", "event_id").alias("base"))
    return e.join(base, "user_id", "left").select("event_id", F.round(F.when(F.col("base") > 0, F.col("value") / F.col("base")), 6).alias("ratio"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q_join_lookup(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(n, "s_nationkey").select("s_suppkey", "n_name")


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def q_join_semi(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query("""
WITH a AS (SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)), f AS (SELECT doc_id FROM a ORDER BY doc_id LIMIT 5)
SELECT (SELECT count(*) FROM a) AS n_missing, (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM f) AS first_ids
""")
def q_join_anti_audit(spark, sf):
    return relational.anti_audit(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").withColumn("first_ids", F.col("first_ids").cast("string"))


@query("SELECT r_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def q_join_chained(spark, sf):
    # counted by supplier first: the joins then see a row a supplier, not a row a line
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    return lines.join(s, "s_suppkey").join(n, "s_nationkey").join(table(spark, sf, "region"), "r_regionkey").groupBy("r_name").agg(F.sum("n").alias("n"))


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def q_join_left_default(spark, sf):
    return relational.left_default(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", {"quality": -1})


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT)".replace("\\\\", "\\"))
def q_join_key_normalise(spark, sf):
    c = table(spark, sf, "customer").select("c_name", F.regexp_extract("c_name", r"(\d+)$", 1).try_cast("bigint").alias("o_custkey")).where("o_custkey is not null")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").select("o_orderkey", "c_name")


@query("SELECT o_orderstatus, " + ", ".join(f"bool_or(o_orderpriority = '{p}') AS p{k}" for k, p in enumerate(("1-URGENT", "3-MEDIUM", "5-LOW"))) + " FROM orders GROUP BY o_orderstatus")
def q_fold_matrix(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderstatus").agg(*[F.bool_or(F.col("o_orderpriority") == p).alias(f"p{k}") for k, p in enumerate(("1-URGENT", "3-MEDIUM", "5-LOW"))])


@query("SELECT r_name, n_name, CAST(level AS INTEGER) AS level FROM region CROSS JOIN nation CROSS JOIN (SELECT unnest(range(1, 6)) AS level)")
def q_cross_grid(spark, sf):
    levels = spark.range(1, 6).select(F.col("id").cast("int").alias("level"))
    return table(spark, sf, "region").select("r_name").crossJoin(table(spark, sf, "nation").select("n_name")).crossJoin(levels)


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), nullif(regexp_extract(source, '(\\d+)$', 1), ''), 'none') AS label FROM documents LEFT JOIN labels USING (doc_id)".replace("\\\\", "\\"))
def q_fallback_chain(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.nullif(F.regexp_extract("source", r"(\d+)$", 1), F.lit("")), F.lit("none")).alias("label"))


@query("""
WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation), b AS (SELECT r_name, CAST(unnest(range(r_regionkey * 5, r_regionkey * 5 + 5)) AS BIGINT) AS p FROM region)
SELECT n_name, r_name FROM a JOIN b USING (p)
""")
def q_join_positional_range(spark, sf):
    a = selection.with_positions(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", name="p")
    b = table(spark, sf, "region").select("r_name", F.explode(F.sequence(F.col("r_regionkey").cast("long") * 5, F.col("r_regionkey").cast("long") * 5 + 4)).alias("p"))
    return a.join(b, "p").select("n_name", "r_name")


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def q_union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def q_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def q_except(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def q_union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY user_id")
def q_first_seen_distinct(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_seen"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_totalprice IS NOT NULL) WHERE r = 1")
def q_best_run_per_group(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice is not null").select("o_orderkey", "o_custkey", "o_totalprice")
    return relational.first_by(o, ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "o_custkey")


@query("SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order FROM orders GROUP BY o_orderpriority")
def q_best_config(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best_order"))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth FROM events")
def q_row_index_in_group(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("nth"))

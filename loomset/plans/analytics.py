"""Queries of aggregates, rank correlation, neighbours and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.operators import knn, relational, selection
from loomset.plans.catalogue import query, table

_STATUS = ["F", "O", "P"]


@query("SELECT quality, count(DISTINCT source) AS n_sources, round(avg(n_chars), 4) AS mean_chars, round(coalesce(stddev_samp(n_chars), 0), 4) AS std_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def q_group_nulls_std(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("quality").agg(F.countDistinct("source").alias("n_sources"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.coalesce(F.stddev_samp("n_chars"), F.lit(0)), 4).alias("std_chars"))


def _pivot(spark, sf, f):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", _STATUS).agg(F.round(f("o_totalprice"), 3))


def _pivot_sql(f):
    return "SELECT o_orderpriority, " + ", ".join(f"round({f}(o_totalprice) FILTER (o_orderstatus = '{s}'), 3) AS \"{s}\"" for s in _STATUS) + " FROM orders GROUP BY 1"


@query(_pivot_sql("avg"))
def q_pivot_mean(spark, sf):
    return _pivot(spark, sf, F.avg)


@query(_pivot_sql("stddev_samp"))
def q_pivot_std(spark, sf):
    return _pivot(spark, sf, F.stddev_samp)


@query(_pivot_sql("max"))
def q_pivot_max(spark, sf):
    return _pivot(spark, sf, F.max)


@query("""
WITH p AS (SELECT o_orderpriority, o_totalprice AS x FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderpriority, max(o_totalprice) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT o_orderpriority, round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS std, count(*) AS n FROM p GROUP BY 1
""")
def q_pooled_mean_std(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    rest = o.where("o_orderstatus <> 'P'").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("x"))
    p = o.where("o_orderstatus = 'P'").select("o_orderpriority", F.col("o_totalprice").alias("x")).unionByName(rest)
    return p.groupBy("o_orderpriority").agg(F.round(F.avg("x"), 3).alias("mean"), F.round(F.stddev_samp("x"), 3).alias("std"), F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2)
SELECT o_orderstatus AS section, round(avg(x), 3) AS mean FROM c GROUP BY 1 UNION ALL SELECT 'all', round(avg(x), 3) FROM c
""")
def q_section_averages(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("x"))
    return c.rollup("o_orderstatus").agg(F.round(F.avg("x"), 3).alias("mean"), F.grouping("o_orderstatus").alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col("o_orderstatus")).alias("section"), "mean")


@query("""
WITH c AS (SELECT quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality),
t AS (SELECT *, n / sum(n) OVER () AS p, count(*) OVER () AS k, max(n) OVER () AS hi, min(n) OVER () AS lo FROM c)
SELECT CAST(any_value(k) AS BIGINT) AS n_classes, CAST(sum(n) AS BIGINT) AS n_rows,
  round(CASE WHEN any_value(k) <= 1 THEN 1.0 ELSE -sum(p * ln(p)) / ln(any_value(k)) END, 6) AS balance,
  round(any_value(hi) / any_value(lo), 6) AS imbalance FROM t
""")
def q_class_balance(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id")
    return relational.class_balance(joined, "quality")


@query("""
SELECT round(avg(n_chars), 4) AS mean_chars, count(*) AS n FROM (SELECT n_chars, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 16
""")
def q_sample_means(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return selection.sample_exact(d, 16, 0, "doc_id").agg(F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r
""")
def q_spearman(spark, sf):
    return relational.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("n", F.round("rho", 6).alias("rho"))


@query("SELECT CASE WHEN value IS NULL THEN 'null' WHEN value < 10 THEN 'small' WHEN value < 50 THEN 'middle' ELSE 'large' END AS reason, count(*) AS n FROM events GROUP BY 1")
def q_skip_reasons(spark, sf):
    v = F.col("value")
    reason = F.when(v.isNull(), "null").when(v < 10, "small").when(v < 50, "middle").otherwise("large")
    return table(spark, sf, "events").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(CASE WHEN count(*) > 0 THEN sum(value) / count(*) END, 4) AS mean, round(greatest(0, sum(value) - 20 * count(*)), 4) AS residual,
  round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) ELSE 0 END, 6) AS rate FROM events GROUP BY event_type
""")
def q_stage_profile(spark, sf):
    s, n = F.sum("value"), F.count(F.lit(1))
    return table(spark, sf, "events").groupBy("event_type").agg(
        n.alias("calls"), F.round(s, 4).alias("total"), F.round(F.try_divide(s, n), 4).alias("mean"), F.round(F.greatest(F.lit(0.0), s - 20 * n), 4).alias("residual"), F.round(F.when(s > 0, n / s).otherwise(0.0), 6).alias("rate")
    )


@query("SELECT count(*) AS n_rows, count(DISTINCT event_id // 1000) AS n_shards, CAST(sum(event_id) AS BIGINT) AS total FROM events")
def q_totals(spark, sf):
    return table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.floor(F.col("event_id") / 1000)).alias("n_shards"), F.sum("event_id").alias("total"))


_NEAR = """
WITH p AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, b.label AS l, a.label AS own, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, neighbour) AS rank FROM p)
"""


@query(_NEAR + "SELECT key, neighbour, rank FROM n WHERE rank <= 10")
def q_knn_top10(spark, sf):
    return knn.neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)


@query(
    _NEAR
    + """, v AS (SELECT key, own, l, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, l) AS r FROM n WHERE rank <= 10 GROUP BY key, own, l),
a AS (SELECT own, avg(CASE WHEN own = l THEN 1.0 ELSE 0 END) AS a, count(*) AS n FROM v WHERE r = 1 GROUP BY own)
SELECT round(avg(a), 6) AS macro_accuracy, round(sum(a * n) / sum(n), 6) AS accuracy FROM a"""
)
def q_knn_vote_accuracy(spark, sf):
    e = table(spark, sf, "embeddings")
    v = knn.votes(knn.neighbours(e, "vec_id", "embedding", 10), e, "vec_id", "label")
    a = knn.macro_accuracy(v.join(e.select(F.col("vec_id").alias("key"), "label"), "key"))
    return a.select(F.round("macro_accuracy", 6).alias("macro_accuracy"), F.round("accuracy", 6).alias("accuracy"))


@query()
def q_rank_me(spark, sf):
    return spark.createDataFrame([(round(knn.rank_me(table(spark, sf, "embeddings"), "embedding"), 4),)], "rank_me double")


# beyond the reference: what Spark has for event time


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_tumbling(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def q_session(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")

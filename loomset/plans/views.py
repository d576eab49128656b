"""Queries of scans, positional access, filters, samples and orders."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from loomset.operators import ordering, relational, selection
from loomset.plans.catalogue import query, table


@query("SELECT event_id, user_id AS who, event_type FROM events")
def q_scan_project(spark, sf):
    return table(spark, sf, "events").withColumnRenamed("user_id", "who").drop("ts", "value", "props")


@query("SELECT * FROM region")
def q_scan_in_memory(spark, sf):
    return spark.createDataFrame(table(spark, sf, "region").toArrow())


@query("SELECT event_id, event_type FROM events WHERE event_id BETWEEN 100 AND 499")
def q_slice_range(spark, sf):
    return selection.sliced(table(spark, sf, "events"), 100, 500, pos="event_id").select("event_id", "event_type")


@query("SELECT event_id, CAST((event_id - 100) // 7 AS BIGINT) AS slot FROM events WHERE event_id BETWEEN 100 AND 499 AND (event_id - 100) % 7 = 0")
def q_slice_step(spark, sf):
    return selection.sliced(table(spark, sf, "events"), 100, 500, 7, pos="event_id").select("event_id", "slot")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS slot FROM orders")
def q_slice_reverse(spark, sf):
    return selection.with_positions(table(spark, sf, "orders").select("o_orderkey"), F.desc("o_orderkey"), name="slot")


@query("SELECT event_id, user_id FROM events WHERE event_id = (SELECT max(event_id) FROM events)")
def q_index_negative(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    n = e.count()  # answered by the footers
    return e.where(F.col("event_id") == n - 1)


@query("SELECT v.slot, e.event_id, e.event_type FROM (VALUES (0::BIGINT, 17), (1, 3), (2, 17), (3, 950), (4, 0)) v(slot, id) JOIN events e ON e.event_id = v.id")
def q_select_indices(spark, sf):
    return selection.at_indices(table(spark, sf, "events"), [17, 3, 17, 950, 0], pos="event_id").select("slot", "event_id", "event_type")


@query("""
WITH s AS (SELECT event_id, row_number() OVER (ORDER BY md5('3:' || event_id), event_id) - 1 AS p FROM events),
v AS (SELECT event_id, p // 2 AS p FROM s WHERE p % 2 = 0)
SELECT event_id, p - 10 AS slot FROM v WHERE p >= 10 AND p < 60
""")
def q_view_compose(spark, sf):
    s = selection.shuffled(table(spark, sf, "events").select("event_id"), 3, "event_id", name="p")
    even = s.where("p % 2 = 0").withColumn("p", F.floor(F.col("p") / 2))
    return selection.sliced(even, 10, 60, pos="p").select("event_id", "slot")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 AND l_discount >= 0.05 AND l_returnflag = 'R'")
def q_filter_expr(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity < 5 and l_discount >= 0.05 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
def q_filter_batched_udf(spark, sf):
    @F.arrow_udf("boolean")
    def large(price: pa.Array, discount: pa.Array) -> pa.Array:
        return pc.greater(pc.multiply(price, pc.subtract(1.0, discount)), 50000.0)

    return table(spark, sf, "lineitem").where(large("l_extendedprice", "l_discount")).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_filter_semi_list(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT page_id FROM pages WHERE contains(url, '/') AND NOT contains(url, '/.') AND (suffix(url, '1') OR prefix(url, 'http')) AND len(string_split(url, '/')) >= 4")
def q_filter_path_predicates(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").where(u.contains("/") & ~u.contains("/.") & (u.endswith("1") | u.startswith("http")) & (F.size(F.split(u, "/")) >= 4)).select("page_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1")
def q_filter_null_passes(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").where("quality is null or quality = 1").select("doc_id")


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN label >= 0 AND label < 10 THEN 0 ELSE 1 END) AS BIGINT) AS out_of_range FROM embeddings")
def q_label_range_guard(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("label").between(0, 9)).alias("out_of_range"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL")
def q_skip_malformed(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k")).where("k is not null")


@query("SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS pos FROM events")
def q_shuffle_positions(spark, sf):
    return selection.shuffled(table(spark, sf, "events").select("event_id"), 42, "event_id", name="pos")


@query("""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos FROM documents)
SELECT doc_id, pos >= CAST(floor((SELECT count(*) FROM documents) * 0.9) AS BIGINT) AS is_test FROM p
""")
def q_train_test_split(spark, sf):
    d = selection.shuffled(table(spark, sf, "documents").select("doc_id"), 42, "doc_id")
    train, test = selection.split_at(d, table(spark, sf, "documents").count(), 0.1, selection.POS)
    return train.select("doc_id", F.lit(False).alias("is_test")).unionByName(test.select("doc_id", F.lit(True).alias("is_test")))


@query("""
SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('7:' || c_custkey), c_custkey) AS r FROM customer)
WHERE r <= greatest(1, CAST(floor((SELECT count(*) FROM customer) * 0.05) AS BIGINT))
""")
def q_sample_exact(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return selection.sample_exact(c, max(1, int(c.count() * 0.05)), 7, "c_custkey")


@query("SELECT event_id FROM events WHERE event_id % 4 = 1")
def q_worker_modulo(spark, sf):
    return ordering.for_worker(table(spark, sf, "events").withColumn("shard", F.floor(F.col("event_id") / 100)), 1, 4, "shard", "event_id", shards=2).select("event_id")


@query("SELECT event_id FROM events WHERE (event_id // 100) % 4 = 1")
def q_shard_modulo(spark, sf):
    return ordering.for_worker(table(spark, sf, "events").withColumn("shard", F.floor(F.col("event_id") / 100)), 1, 4, "shard", "event_id", shards=10).select("event_id")


@query("""
WITH e AS (SELECT event_id, event_id // 250 AS shard FROM events)
SELECT event_id, row_number() OVER (ORDER BY md5('13:' || shard), shard, md5('13:' || event_id), event_id) - 1 AS pos FROM e
""")
def q_epoch_order(spark, sf):
    e = table(spark, sf, "events").select("event_id").withColumn("shard", F.floor(F.col("event_id") / 250))
    return ordering.epoch_positions(e, 9, 4, "shard", "event_id", "pos").select("event_id", "pos")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id // 1000, md5('5:' || event_id), event_id) - 1 AS pos FROM events")
def q_buffer_shuffle(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    return selection.with_positions(e, *ordering.buffer_order(5, "event_id", 1000), name="pos")


@query("SELECT event_id // 1000 AS shard_id, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY event_id // 1000 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row FROM events GROUP BY 1")
def q_shard_offsets(spark, sf):
    n = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("shard_id")).agg(F.count(F.lit(1)).alias("n"))
    return relational.running_base(n, "shard_id", "n", "first_row")


@query("SELECT event_id, event_id // 2500 % 4 AS a, event_id // 50 % 50 AS b, event_id % 50 AS c FROM events")
def q_mixed_radix(spark, sf):
    digit = lambda base, size: F.floor(F.col("event_id") / base) % size
    return table(spark, sf, "events").select("event_id", digit(2500, 4).alias("a"), digit(50, 50).alias("b"), digit(1, 50).alias("c"))


@query("SELECT event_id, CAST(least(5, event_id // 2000 + 1) AS BIGINT) AS level FROM events")
def q_block_level(spark, sf):
    return table(spark, sf, "events").select("event_id", F.least(F.lit(5), F.floor(F.col("event_id") / 2000) + 1).cast("long").alias("level"))


@query("""
WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
SELECT doc_id, source FROM f WHERE r = 1 ORDER BY doc_id LIMIT 10
""")
def q_first_per_class(spark, sf):
    first = table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return first.orderBy("doc_id").limit(10).select("doc_id", "source")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q_top_k(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT s.i AS step, e.event_id FROM (SELECT unnest(range(0, (SELECT 5 * count(*) // 2 FROM events))) AS i) s JOIN events e ON e.event_id = s.i % (SELECT count(*) FROM events)")
def q_cycle_batches(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    n = e.count()
    return spark.range(5 * n // 2).select(F.col("id").alias("step"), (F.col("id") % n).alias("event_id")).join(e, "event_id").select("step", "event_id")

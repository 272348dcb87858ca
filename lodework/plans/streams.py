"""Queries over incremental views, change feeds and queues."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodework.operators.joins import asof_join
from lodework.plans.registry import plan
from lodework.session import scratch_path
from lodework.streaming.extremes import extremes_view, read_extremes
from lodework.streaming.feeds import ReplicationSet, parse_changes
from lodework.streaming.queues import queue_state
from lodework.streaming.replicate import read_copy, replicate_tables
from lodework.streaming.views import incremental_view, read_view, rollup_buckets, run_to_end, signed_view, time_bucket_agg


def cores(spark) -> int:
    """State partitions for a run over a whole table: one per core of the cluster."""
    return spark.sparkContext.defaultParallelism


def as_stream(spark, df):
    """The rows of a table as a stream.

    The table is written as it is partitioned, each task's rows over a few files; a micro-batch takes so many files
    that a quarter of the cores read one each.
    """
    path = scratch_path(spark, "stream-source")
    part = F.pmod(F.xxhash64(*df.columns), F.lit(3)).alias("_part")
    df.select("*", part).write.partitionBy("_part").parquet(path)
    files = max(1, spark.sparkContext.defaultParallelism // 4)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).drop("_part")


@plan("incremental_view", """
SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_totalprice) AS largest FROM orders GROUP BY 1
""")
def incremental(spark, t):
    path = scratch_path(spark, "view")
    stream = as_stream(spark, t.orders.select("o_custkey", "o_totalprice"))
    aggs = [F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.max("o_totalprice").alias("largest")]
    run_to_end(incremental_view(stream, ["o_custkey"], aggs), path, partitions=cores(spark))
    return read_view(spark, path, ["o_custkey"]).withColumn("total", F.col("total").cast("double"))


@plan("view_with_deletes", """
SELECT o_custkey, count(*) AS row_count, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1
""")
def view_with_deletes(spark, t):
    rows = t.orders.select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), "o_orderkey")
    signed = rows.withColumn("sign", F.lit(1)).unionByName(rows.where("o_orderkey % 5 = 0").withColumn("sign", F.lit(-1)))
    path = scratch_path(spark, "signed")
    run_to_end(signed_view(as_stream(spark, signed), ["o_custkey"], "sign", {"cents": "price"}), path, partitions=cores(spark))
    return read_view(spark, path, ["o_custkey"]).where("row_count > 0")


@plan("extremes_with_deletes", """
SELECT o_orderpriority, count(*) AS row_count, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1
""")
def extremes_with_deletes(spark, t):
    rows = t.orders.select("o_orderpriority", "o_totalprice", "o_orderkey")
    signed = rows.withColumn("sign", F.lit(1)).unionByName(rows.where("o_orderkey % 5 = 0").withColumn("sign", F.lit(-1)))
    path = scratch_path(spark, "extremes")
    run_to_end(extremes_view(as_stream(spark, signed), ["o_orderpriority"], "o_totalprice", "sign"), path, partitions=cores(spark))
    return read_extremes(spark, path, ["o_orderpriority"])


@plan("continuous_aggregate", """
SELECT 'hour' AS step, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 2, 3
UNION ALL SELECT 'day', date_trunc('day', ts)::TIMESTAMP, event_type, count(*), CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) FROM events GROUP BY 2, 3
""")
def continuous_aggregate(spark, t):
    path = scratch_path(spark, "buckets")
    stream = as_stream(spark, t.events.select("ts", "event_type", "value"))
    # files arrive in any order here, so the watermark leaves room for the whole span of the table
    hourly = time_bucket_agg(stream, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")],
                             watermark="400 days")
    run_to_end(hourly, path, partitions=cores(spark))
    hours = read_view(spark, path, ["bucket", "event_type"])
    days = rollup_buckets(hours, "day", ["event_type"], ["n", "total"])
    both = hours.withColumn("step", F.lit("hour")).unionByName(days.withColumn("step", F.lit("day")))
    return both.withColumn("total", F.col("total").cast("double"))


def change_feed(t):
    """Every order is inserted; some are then updated to twice the price, some deleted."""
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(n) for n in ("o_orderkey", "o_orderstatus", "o_totalprice")])

    def change(kind, price):
        values = F.array(key.cast("string"), F.col("o_orderstatus"), price.cast("decimal(18,2)").cast("string"))
        return F.struct(F.lit(kind).alias("kind"), F.lit("orders").alias("table"), names.alias("names"), values.alias("values"),
                        F.create_map(F.lit("o_orderkey"), key.cast("string")).alias("key"))

    def records(rows, step, kind, price):
        return rows.select(F.to_json(F.struct((key * 10 + step).alias("pos"), F.array(change(kind, price)).alias("change"))).alias("value"))

    price = F.col("o_totalprice")
    other = t.customer.select(F.to_json(F.struct(F.col("c_custkey").alias("pos"), F.array(F.struct(
        F.lit("insert").alias("kind"), F.lit("customer").alias("table"), F.array(F.lit("c_custkey")).alias("names"),
        F.array(F.col("c_custkey").cast("string")).alias("values"), F.create_map(F.lit("c_custkey"), F.col("c_custkey").cast("string")).alias("key"))).alias("change"))).alias("value"))
    return (records(t.orders, 0, "insert", price).unionByName(records(t.orders.where(key % 3 == 0), 1, "update", price * 2))
            .unionByName(records(t.orders.where(key % 7 == 0), 2, "delete", price)).unionByName(other))


@plan("change_feed_parse", """
SELECT kind, 'orders' AS "table", count(*) AS changes, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS total, max(pos) AS last_pos FROM (
 SELECT 'insert' AS kind, o_totalprice AS price, o_orderkey * 10 AS pos FROM orders UNION ALL
 SELECT 'update', o_totalprice * 2, o_orderkey * 10 + 1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
 SELECT 'delete', o_totalprice, o_orderkey * 10 + 2 FROM orders WHERE o_orderkey % 7 = 0) GROUP BY 1
UNION ALL SELECT 'insert', 'customer', count(*), NULL, max(c_custkey) FROM customer
""")
def change_feed_parse(spark, t):
    price = F.try_element_at("fields", F.lit("o_totalprice")).cast("decimal(18,2)")
    return parse_changes(change_feed(t)).groupBy("kind", "table").agg(
        F.count(F.lit(1)).alias("changes"), F.sum(price).cast("double").alias("total"), F.max("pos").alias("last_pos"))


@plan("replicate_tables", """
SELECT o_orderkey, o_orderstatus, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS DECIMAL(18,2))::DOUBLE AS o_totalprice
FROM orders WHERE o_orderkey % 7 <> 0
""")
def replicated(spark, t):
    followed = (ReplicationSet().add_table("orders", ["o_orderkey"], "o_orderkey bigint, o_orderstatus string, o_totalprice double")
                .add_table("customer", ["c_custkey"], "c_custkey bigint").remove_table("customer"))
    path = scratch_path(spark, "copies")
    replicate_tables(parse_changes(as_stream(spark, change_feed(t))), followed, path)
    return read_copy(spark, path, "orders", followed)


@plan("queue_lifecycle", """
WITH s AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'),
o AS (SELECT e.user_id, e.ts, e.event_type, s.event_id AS msg FROM events e ASOF JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts WHERE e.event_type IN ('view', 'purchase')),
r AS (SELECT msg, count(*) FILTER (WHERE event_type = 'view') AS reads, max(ts) FILTER (WHERE event_type = 'view') AS last_read,
             min(ts) FILTER (WHERE event_type = 'purchase') AS gone FROM o GROUP BY 1)
SELECT 'user-' || s.user_id AS queue, s.event_id AS msg_id, s.ts AS sent_at, coalesce(reads, 0) AS read_count, coalesce(last_read + INTERVAL 1 HOUR, s.ts) AS visible_at,
       gone AS gone_at, CASE WHEN gone IS NULL THEN 'queue' ELSE 'archive' END AS place FROM s LEFT JOIN r ON s.event_id = r.msg
""")
def queue_lifecycle(spark, t):
    sent = t.events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("msg_id"), F.col("props").alias("message"))
    acts = t.events.where("event_type IN ('view', 'purchase')").select("user_id", "ts", "event_id", "event_type")
    touched = asof_join(acts, sent.select("user_id", "ts", "msg_id"), ["user_id"], "ts", ["event_id"], ["msg_id"]).where("msg_id IS NOT NULL")
    queue = F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("queue")
    ops = (sent.select(queue, "msg_id", F.lit("send").alias("op"), "ts", "message")
           .unionByName(touched.select(queue, "msg_id", F.when(F.col("event_type") == "view", "read").otherwise("archive").alias("op"), "ts",
                                       F.lit(None).cast("string").alias("message"))))
    path = scratch_path(spark, "queue")
    run_to_end(queue_state(as_stream(spark, ops), "1 hour"), path, partitions=cores(spark))
    return read_view(spark, path, ["queue", "msg_id"]).drop("message")

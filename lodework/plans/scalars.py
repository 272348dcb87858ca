"""Queries over column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.functions.ids import decode_ids, encode_ids
from lodework.functions.json import json_schema_audit, json_where, nest
from lodework.functions.text import char_inventory, fold_keys
from lodework.functions.times import (assign_uuid7, cron_runs, from_nanos, nanos_bucket, rrule_occurrences, to_nanos,
                                      uuid7_ts)
from lodework.plans.registry import plan


@plan("nvl_decode_lpad", """
SELECT event_id, coalesce(nullif(event_type, 'view'), 'fallback') AS filled,
       CASE event_type WHEN 'signup' THEN 'one' WHEN 'purchase' THEN 'two' ELSE 'other' END AS decoded,
       lpad(CAST(event_id AS VARCHAR), 8, '*') AS padded FROM events
""")
def nvl_decode_lpad(spark, t):
    kind = F.col("event_type")
    return t.events.select("event_id", F.nvl(F.nullif(kind, F.lit("view")), F.lit("fallback")).alias("filled"),
                           F.expr("decode(event_type, 'signup', 'one', 'purchase', 'two', 'other')").alias("decoded"),
                           F.lpad(F.col("event_id").cast("string"), 8, "*").alias("padded"))


@plan("date_parts", """
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 400 AS INTEGER) AS b FROM orders)
SELECT o_orderkey, last_day(a) AS month_end, CAST(day(a) AS BIGINT) AS day,
       round(CASE WHEN day(a) = day(b) OR (a = last_day(a) AND b = last_day(b)) THEN (year(a) - year(b)) * 12 + month(a) - month(b)
             ELSE (year(a) - year(b)) * 12 + month(a) - month(b) + (day(a) - day(b)) / 31.0 END, 6)::DOUBLE AS months FROM d
""")
def date_parts(spark, t):
    a = F.col("o_orderdate").cast("date")
    b = F.date_sub(a, (F.col("o_orderkey") % 400).cast("int"))
    return t.orders.select("o_orderkey", F.last_day(a).alias("month_end"), F.day(a).cast("long").alias("day"),
                           F.round(F.months_between(a, b), 6).alias("months"))


@plan("fold_ascii", """
SELECT doc_id, trim(regexp_replace(lower(replace(replace(replace(replace(replace(strip_accents(text), 'ß', 'ss'), 'Æ', 'AE'), 'æ', 'ae'), 'Œ', 'OE'), 'œ', 'oe')), '\\s+', ' ', 'g')) AS match_key FROM documents
""")
def fold(spark, t):
    return fold_keys(t.documents, "text").select("doc_id", "match_key")


@plan("char_inventory", """
WITH c AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS char FROM documents)
SELECT char, count(*) AS uses, CAST(unicode(char) AS BIGINT) AS code_point FROM c GROUP BY 1
""")
def inventory(spark, t):
    return char_inventory(t.documents, "text").select("char", "uses", "code_point")


@plan("recurrence_expand", """
WITH r AS (SELECT p_partkey, p_partkey % 3 AS f, 1 + p_partkey % 4 AS every, p_size AS n,
                  TIMESTAMP '2024-01-01 08:30:00' + to_days(CAST(p_partkey % 28 AS INTEGER)) AS s FROM part)
SELECT p_partkey, CAST(k + 1 AS BIGINT) AS seq,
       CASE f WHEN 0 THEN s + to_days(CAST(k * every AS INTEGER)) WHEN 1 THEN s + to_days(CAST(7 * k * every AS INTEGER))
              ELSE s + to_months(CAST(k * every AS INTEGER)) END AS occurrence
FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM r)
""")
def recurrence(spark, t):
    rules = t.part.select("p_partkey", F.expr("""'FREQ=' || element_at(array('DAILY', 'WEEKLY', 'MONTHLY'), CAST(p_partkey % 3 AS INT) + 1)
        || ';INTERVAL=' || (1 + p_partkey % 4) || ';COUNT=' || p_size""").alias("rule"),
        F.expr("timestamp_ntz '2024-01-01 08:30:00' + make_dt_interval(CAST(p_partkey % 28 AS INT))").alias("start"))
    return rrule_occurrences(rules, "rule", "start", "2060-01-01").select("p_partkey", "seq", "occurrence")


@plan("recurrence_byday", """
WITH r AS (SELECT s_suppkey, 1 + s_suppkey % 3 AS every, 5 + s_suppkey % 20 AS n, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 31 AS INTEGER)) AS s FROM supplier),
d AS (SELECT *, unnest(generate_series(s, TIMESTAMP '2026-12-31', INTERVAL 1 DAY)) AS occurrence FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY occurrence) AS seq FROM d
      WHERE isodow(occurrence) IN (1, 3, 5) AND date_diff('day', date_trunc('week', s), date_trunc('week', occurrence)) // 7 % every = 0)
SELECT s_suppkey, seq, occurrence FROM k WHERE seq <= n
""")
def recurrence_byday(spark, t):
    rules = t.supplier.select("s_suppkey", F.expr("'FREQ=WEEKLY;BYDAY=MO,WE,FR;INTERVAL=' || (1 + s_suppkey % 3) || ';COUNT=' || (5 + s_suppkey % 20)").alias("rule"),
                              F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(CAST(s_suppkey % 31 AS INT))").alias("start"))
    return rrule_occurrences(rules, "rule", "start", "2026-12-31").select("s_suppkey", "seq", "occurrence")


@plan("cron_expand", """
WITH m AS (SELECT unnest(generate_series(TIMESTAMP '2024-03-01', TIMESTAMP '2024-03-10 23:59:00', INTERVAL 1 MINUTE)) AS due)
SELECT s_suppkey, due FROM supplier, m WHERE CASE s_suppkey % 4
 WHEN 0 THEN minute(due) % 15 = 0 AND hour(due) = s_suppkey % 24
 WHEN 1 THEN minute(due) IN (s_suppkey % 60, (s_suppkey + 7) % 60) AND hour(due) BETWEEN 8 AND 18
 WHEN 2 THEN minute(due) = 30 AND hour(due) % 6 = 0 AND dayofweek(due) BETWEEN 1 AND 5
 ELSE minute(due) = 0 AND hour(due) = 12 AND (day(due) = 1 + s_suppkey % 28 OR dayofweek(due) = 0) END
""")
def cron_expand(spark, t):
    jobs = t.supplier.select("s_suppkey", F.expr("""CASE s_suppkey % 4
        WHEN 0 THEN '*/15 ' || (s_suppkey % 24) || ' * * *'
        WHEN 1 THEN (s_suppkey % 60) || ',' || ((s_suppkey + 7) % 60) || ' 8-18 * * *'
        WHEN 2 THEN '30 */6 * 1-12 1-5'
        ELSE '0 12 ' || (1 + s_suppkey % 28) || ' * 7' END""").alias("schedule"))
    return cron_runs(jobs, "schedule", "2024-03-01", "2024-03-11").select("s_suppkey", "due")


@plan("nanos_time", """
WITH n AS (SELECT epoch_us(ts) * 1000 + event_id % 1000 AS ns FROM events)
SELECT ns - ns % 60000000000 AS bucket, count(*) AS events, count(DISTINCT ns) AS instants, min(ns) AS first_ns,
       make_timestamp(max(ns) // 1000) AS last_ts FROM n GROUP BY 1
""")
def nanos_time(spark, t):
    ns = t.events.select(to_nanos(F.col("ts"), F.col("event_id") % 1000).alias("ns"))
    return nanos_bucket(ns, "ns", 60_000_000_000).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("ns").alias("instants"), F.min("ns").alias("first_ns"),
        from_nanos(F.max("ns")).alias("last_ts"))


@plan("time_ordered_id", """
WITH m AS (SELECT event_id, ts, lpad(format('{:x}', epoch_us(ts) // 1000), 12, '0') AS h, md5(CAST(event_id AS VARCHAR)) AS r FROM events)
SELECT event_id, left(h, 8) || '-' || right(h, 4) || '-7' || left(r, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(r, 4, 1))::INT - 1) % 4 + 1, 1)
       || substr(r, 5, 3) || '-' || substr(r, 8, 12) AS id, date_trunc('milliseconds', ts) AS decoded FROM m
""")
def time_ordered_id(spark, t):
    df = assign_uuid7(t.events, "ts", "event_id")
    return df.select("event_id", "id", uuid7_ts(F.col("id")).alias("decoded"))


@plan("mask_ids", "SELECT o_orderkey, o_orderkey AS decoded, true AS hidden, CAST(1 AS BIGINT) AS uses FROM orders")
def mask_ids(spark, t):
    coded = encode_ids(t.orders.select("o_orderkey"), "o_orderkey", "pepper")
    uses = coded.groupBy("code").agg(F.count(F.lit(1)).alias("uses"), F.min("o_orderkey").alias("o_orderkey"))
    return decode_ids(uses, "code", "pepper", "decoded").select(
        "o_orderkey", "decoded", (F.length("code") > 0).alias("hidden"), "uses")


@plan("array_reduce", """
SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total, CAST(len(embedding) AS BIGINT) AS n, embedding[1]::DOUBLE AS head,
       CAST(len(list_filter(embedding, lambda x : x > 0)) AS BIGINT) AS positive FROM embeddings
""")
def array_reduce(spark, t):
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.round(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), 5).alias("total"),
        F.size(e).cast("long").alias("n"), F.element_at(e, 1).cast("double").alias("head"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"))


@plan("map_lookup", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type AS kind, NULL::VARCHAR AS absent FROM events
""")
def map_lookup(spark, t):
    held = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    return (t.events.withColumn("m", held)
            .select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("type")).alias("kind"),
                    F.try_element_at("m", F.lit("none")).alias("absent")))


@plan("json_path", """
SELECT event_id, 'high' AS test FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90
UNION ALL SELECT event_id, 'equal' FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 42
UNION ALL SELECT event_id, 'nested' FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7
""")
def json_path(spark, t):
    high = json_where(t.events, "props", "$.k", ">=", 90).select("event_id", F.lit("high").alias("test"))
    equal = json_where(t.events, "props", "$.k", "=", 42).select("event_id", F.lit("equal").alias("test"))
    wrapped = t.events.select("event_id", F.concat(F.lit('{"a": '), "props", F.lit("}")).alias("doc"))
    nested = json_where(wrapped, "doc", "$.a.k", "=", 7).select("event_id", F.lit("nested").alias("test"))
    none = json_where(t.events, "props", "$.k.b", "=", 7).select("event_id", F.lit("never").alias("test"))
    return high.unionByName(equal).unionByName(nested).unionByName(none)


@plan("json_schema_audit", """
SELECT '$.k maximum' AS rule, count(*) AS violations FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90
UNION ALL SELECT '$.k minimum', count(*) FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 10
UNION ALL SELECT '$ required user', count(*) FROM events
""")
def schema_audit(spark, t):
    schema = {"type": "object", "required": ["k", "user"], "additionalProperties": False,
              "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}, "user": {"type": "string"}}}
    return json_schema_audit(t.events, "props", schema)


@plan("nested_documents", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
l AS (SELECT o_custkey, i // 12 AS page, string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) AS items
      FROM o GROUP BY 1, 2)
SELECT c_custkey, CAST(coalesce(page, 0) AS BIGINT) AS page,
       '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","children":[' || coalesce(items, '') || ']}' AS document
FROM customer LEFT JOIN l ON c_custkey = o_custkey
""")
def nested_documents(spark, t):
    return nest(t.customer.select("c_custkey", "c_name"), t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"),
                "c_custkey", "o_custkey", [F.asc("o_orderkey")], page_rows=12)

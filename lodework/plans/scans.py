"""Queries over scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.plans.registry import plan
from lodework.session import scratch_path
from lodework.sources.arrow_store import read_store, write_store
from lodework.sources.files import (compact, read_files, read_table, write_partitioned, write_table)
from lodework.sources.rows import csv_agg, run_sql, sample_rows, series, time_series, values_table


@plan("scan_parquet", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus = 'F' AND o_totalprice > 1000
""")
def scan_parquet(spark, t):
    return read_table(spark, f"{t._path}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"],
                      "o_orderdate >= timestamp_ntz '1996-01-01' AND o_orderstatus = 'F' AND o_totalprice > 1000")


@plan("scan_csv_json", """
SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
""")
def scan_csv_json(spark, t):
    csv, json = scratch_path(spark, "csv"), scratch_path(spark, "json")
    write_table(t.customer.drop("c_mktsegment"), csv, "csv", header=True)
    write_table(t.supplier, json, "json")
    customers = read_files(spark, csv, "csv", "c_custkey long, c_name string, c_nationkey int, c_acctbal double", header=True)
    suppliers = read_files(spark, json, "json", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    names = ["id", "name", "nation", "balance"]
    return (customers.toDF(*names).select(F.lit("customer").alias("kind"), *names)
            .unionByName(suppliers.toDF(*names).select(F.lit("supplier").alias("kind"), *names)))


@plan("sql_text", """
SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01'
GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10
""")
def sql_text(spark, t):
    return run_sql(spark, """
        SELECT n_name,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
               count(*) AS lines
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        JOIN {nation} ON c_nationkey = n_nationkey
        WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ)
        GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""",
                   {"since": "1996-01-01"},
                   {"lineitem": t.lineitem, "orders": t.orders, "customer": t.customer, "nation": t.nation})


@plan("generate_series", """
WITH b AS (SELECT min(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) lo,
                  max(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) hi FROM orders),
s AS (SELECT unnest(generate_series(lo, hi, 7)) AS g, lo FROM b),
o AS (SELECT lo + ((date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) - lo) // 7) * 7 AS w, count(*) AS n
      FROM orders, b GROUP BY 1)
SELECT CAST(g AS BIGINT) AS week_start, CAST(coalesce(n, 0) AS BIGINT) AS orders FROM s LEFT JOIN o ON g = w
""")
def generate_series(spark, t):
    days = t.orders.select(F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("d"))
    lo, hi = days.agg(F.min("d"), F.max("d")).first()
    weekly = (days.groupBy((F.lit(lo) + F.floor((F.col("d") - lo) / 7) * 7).cast("long").alias("week_start"))
              .agg(F.count(F.lit(1)).alias("orders")))
    return (series(spark, lo, hi, 7, "week_start").join(weekly, "week_start", "left")
            .select("week_start", F.coalesce("orders", F.lit(0)).alias("orders")))


@plan("generate_date_series", """
WITH b AS (SELECT l_returnflag AS flag, min(l_shipdate) lo, max(l_shipdate) hi FROM lineitem GROUP BY 1),
s AS (SELECT flag, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM b),
n AS (SELECT l_returnflag AS flag, l_shipdate AS day, count(*) AS lines FROM lineitem GROUP BY 1, 2)
SELECT flag, day, CAST(coalesce(lines, 0) AS BIGINT) AS lines FROM s LEFT JOIN n USING (flag, day)
""")
def generate_date_series(spark, t):
    lines = t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("lines"))
    bounds = t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    return (time_series(bounds, "lo", "hi", "1 day", "day").join(lines, ["flag", "day"], "left")
            .select("flag", "day", F.coalesce("lines", F.lit(0)).alias("lines")))


@plan("inline_values", """
SELECT meaning, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM lineitem JOIN (VALUES ('R', 'returned'), ('A', 'accepted'), ('N', 'none')) v(flag, meaning) ON l_returnflag = flag
GROUP BY meaning
""")
def inline_values(spark, t):
    names = values_table(spark, [("R", "returned"), ("A", "accepted"), ("N", "none")], "flag string, meaning string")
    return (t.lineitem.join(names, F.col("l_returnflag") == F.col("flag")).groupBy("meaning")
            .agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("long").alias("quantity")))


@plan("sample_rows", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500
""")
def sample(spark, t):
    return sample_rows(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 500, "o_orderkey")


@plan("write_partitioned", """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2
""")
def partitioned(spark, t):
    path = scratch_path(spark, "events-by-day")
    part = write_partitioned(t.events, path, "ts", "day")
    return (spark.read.parquet(path).groupBy(F.col(part).alias("day"), "event_type")
            .agg(F.count(F.lit(1)).alias("events"),
                 F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")))


@plan("compact_table", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
WHERE o_orderkey IS NOT NULL
""")
def compacted(spark, t):
    path = scratch_path(spark, "bloated")
    write_table(t.orders, path, maxRecordsPerFile=100_000)
    return compact(spark, path, scratch_path(spark, "compact"), ["o_custkey", "o_orderdate"])


@plan("csv_agg", """
WITH r AS (SELECT c_nationkey, c_custkey, c_name, c_mktsegment,
                  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT c_nationkey AS nation, CAST(i // 40 AS BIGINT) AS page,
       string_agg(c_custkey || ',' || c_name || ',' || c_mktsegment, chr(10) ORDER BY c_custkey) AS csv
FROM r GROUP BY 1, 2
""")
def csv_text(spark, t):
    out = csv_agg(t.customer, ["c_nationkey"], ["c_custkey", "c_name", "c_mktsegment"], [F.col("c_custkey").asc()], 40)
    return out.withColumnRenamed("c_nationkey", "nation")


@plan("write_files", """
SELECT f AS fmt, o_orderpriority AS priority, count(*) AS orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_orderdate) AS latest
FROM orders, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) v(f) GROUP BY 1, 2
""")
def written(spark, t):
    parts = []
    for fmt in ("csv", "json", "orc", "parquet"):
        path = scratch_path(spark, f"copy-{fmt}")
        write_table(t.orders, path, fmt)
        back = read_files(spark, path, fmt, t.orders.schema)
        parts.append(back.groupBy(F.lit(fmt).alias("fmt"), F.col("o_orderpriority").alias("priority")).agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
            F.max("o_orderdate").alias("latest")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@plan("federated_scan", """
SELECT c_mktsegment, o_orderstatus, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
GROUP BY 1, 2
""")
def federated_scan(spark, t):
    """Orders lie in a store that answers filters itself; customers are a local table."""
    folder = scratch_path(spark, "store")
    write_store(t.orders.repartitionByRange("o_orderdate"), folder, file_rows=1 << 16)
    remote = read_store(spark, folder, "o_custkey bigint, o_orderdate timestamp_ntz, o_orderstatus string, o_orderpriority string, o_totalprice double")
    year = remote.where("o_orderdate >= timestamp_ntz '1996-01-01' AND o_orderdate < timestamp_ntz '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
    return year.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderstatus").agg(
        F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))

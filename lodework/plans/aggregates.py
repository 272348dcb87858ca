"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.operators.aggregates import bucketed_histogram, first_last, fraction_sum, ordered_array
from lodework.operators.bitmaps import bitmap_build, bitmap_cardinality, bitmap_combine, bitmap_contains, bitmap_rollup
from lodework.operators.sketches import (hll_build, hll_count,
                                         hll_estimate, hll_pair_union, hll_rollup, quantiles, tdigest_build,
                                         tdigest_read, tdigest_rollup)
from lodework.plans.registry import plan
from lodework.session import stage




def money(column):
    return F.col(column).cast("decimal(18,2)")


@plan("agg_group", """
SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       round(avg(l_quantity), 4) AS mean_quantity, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
UNION ALL SELECT 'all', 'all', count(*), CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), round(avg(l_quantity), 4),
       min(l_shipdate), max(l_shipdate) FROM lineitem
""")
def agg_group(spark, t):
    aggs = [F.count(F.lit(1)).alias("lines"), F.sum(money("l_extendedprice")).cast("double").alias("total"),
            F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship")]
    groups = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(*aggs).where("lines > 10")
    whole = t.lineitem.agg(*aggs).select(F.lit("all").alias("l_returnflag"), F.lit("all").alias("l_linestatus"), "*")
    return groups.unionByName(whole)


@plan("agg_distinct", """
SELECT l_shipdate AS day, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1
""")
def agg_distinct(spark, t):
    return t.lineitem.groupBy(F.col("l_shipdate").alias("day")).agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@plan("agg_grouping_sets", """
SELECT 'cube' AS kind, l_returnflag AS a, l_linestatus AS b, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS lines
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
UNION ALL SELECT 'rollup', l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT), count(*)
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
UNION ALL SELECT 'sets', l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT), count(*)
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())
""")
def agg_grouping_sets(spark, t):
    return spark.sql("""
        WITH l AS (SELECT l_returnflag AS a, l_linestatus AS b FROM {lineitem})
        SELECT 'cube' AS kind, a, b, grouping_id(a, b) AS level, count(*) AS lines FROM l GROUP BY CUBE (a, b)
        UNION ALL SELECT 'rollup', a, b, grouping_id(a, b), count(*) FROM l GROUP BY ROLLUP (a, b)
        UNION ALL SELECT 'sets', a, b, grouping_id(a, b), count(*) FROM l GROUP BY GROUPING SETS ((a), (b), ())""",
                     lineitem=t.lineitem)


@plan("agg_ordered_array", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i, o_totalprice FROM orders)
SELECT o_custkey, CAST(i // 10 AS BIGINT) AS page, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS keys,
       count(*) AS n FROM r GROUP BY 1, 2
""")
def agg_ordered_array(spark, t):
    arrays = ordered_array(t.orders, ["o_custkey"], "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)
    return arrays.select("o_custkey", "page", F.array_join(F.col("values").cast("array<string>"), ",").alias("keys"),
                         F.size("values").cast("long").alias("n"))


@plan("agg_first_last", """
SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id
""")
def agg_first_last(spark, t):
    return first_last(t.events, ["user_id"], "event_type", ["ts", "event_id"])


def within(estimate, exact, share):
    return (F.abs(F.col(estimate) - F.col(exact)) <= share * F.col(exact))


@plan("hll_cardinality", "SELECT l_linestatus, l_returnflag, true AS within_5pct FROM lineitem GROUP BY 1, 2")
def hll_cardinality(spark, t):
    keys = ["l_linestatus", "l_returnflag"]
    exact = t.lineitem.groupBy(*keys).agg(F.count_distinct("l_orderkey").alias("exact"))
    return (hll_count(t.lineitem, keys, "l_orderkey").join(exact, keys)
            .select(*keys, within("estimate", "exact", 0.05).alias("within_5pct")))


@plan("hll_union", "SELECT o_orderstatus AS status, true AS within_5pct FROM orders GROUP BY 1")
def hll_union(spark, t):
    orders = t.orders.select(F.col("o_orderstatus").alias("status"), "o_custkey", "o_orderkey", "o_totalprice")
    cheap, dear = orders.where("o_totalprice < 300000"), orders.where("o_totalprice > 200000")
    both = hll_pair_union(hll_build(cheap, ["status"], "o_orderkey"), hll_build(dear, ["status"], "o_orderkey"), ["status"])
    exact = orders.groupBy("status").agg(F.count_distinct("o_orderkey").alias("exact"))
    return (hll_estimate(both).join(exact, "status")
            .select("status", within("estimate", "exact", 0.05).alias("within_5pct")))


@plan("hll_rollup_table", "SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS year, true AS within_5pct FROM lineitem GROUP BY 1")
def hll_rollup_table(spark, t):
    daily = stage(hll_build(t.lineitem.withColumn("day", F.col("l_shipdate").cast("date")), ["day"], "l_orderkey"), "daily-sketches")
    yearly = hll_estimate(hll_rollup(daily.withColumn("year", F.trunc("day", "year")), ["year"]))
    exact = t.lineitem.groupBy(F.trunc("l_shipdate", "year").alias("year")).agg(F.count_distinct("l_orderkey").alias("exact"))
    return yearly.join(exact, "year").select("year", within("estimate", "exact", 0.05).alias("within_5pct"))


def rank_check(rows, estimates, keys, value):
    """Share of rows at or below each estimate lies within one percent of its probability."""
    return (rows.join(estimates, keys).groupBy(*keys, "p")
            .agg(F.avg((F.col(value) <= F.col("quantile")).cast("double")).alias("at"),
                 F.avg((F.col(value) < F.col("quantile")).cast("double")).alias("below"))
            .select(*keys, "p", ((F.col("below") <= F.col("p") + 0.01) & (F.col("at") >= F.col("p") - 0.01)).alias("ok")))


@plan("tdigest_percentile", """
SELECT event_type, p, m AS method, true AS ok FROM (SELECT DISTINCT event_type FROM events),
 (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) v(p), (VALUES ('direct'), ('rollup')) w(m)
""")
def tdigest_percentile(spark, t):
    probs = [0.5, 0.9, 0.99]
    rows = t.events.select("event_type", "value", F.col("ts").cast("date").alias("day"))
    direct = quantiles(rows, ["event_type"], "value", probs)
    daily = stage(tdigest_build(rows, ["event_type", "day"], "value"), "daily-digests")
    rolled = tdigest_read(tdigest_rollup(daily, ["event_type"]), probs)
    return (rank_check(rows, direct, ["event_type"], "value").withColumn("method", F.lit("direct"))
            .unionByName(rank_check(rows, rolled, ["event_type"], "value").withColumn("method", F.lit("rollup"))))


@plan("bitmap_build", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS cardinality FROM lineitem GROUP BY 1")
def bitmap_built(spark, t):
    return bitmap_cardinality(bitmap_build(t.lineitem, ["l_suppkey"], "l_orderkey"), ["l_suppkey"])


@plan("bitmap_and_or", """
WITH a AS (SELECT DISTINCT l_returnflag f, l_orderkey k FROM lineitem WHERE l_linestatus = 'O'),
b AS (SELECT DISTINCT l_returnflag f, l_orderkey k FROM lineitem WHERE l_linestatus = 'F')
SELECT f AS flag, 'and' AS op, count(*) AS cardinality FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 1
UNION ALL SELECT f, 'or', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1
""")
def bitmap_and_or(spark, t):
    lines = t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_linestatus", "l_orderkey")
    a = bitmap_build(lines.where("l_linestatus = 'O'"), ["flag"], "l_orderkey")
    b = bitmap_build(lines.where("l_linestatus = 'F'"), ["flag"], "l_orderkey")
    both = [bitmap_cardinality(bitmap_combine(a, b, ["flag"], op), ["flag"]).select("flag", F.lit(op).alias("op"), "cardinality")
            for op in ("and", "or")]
    return both[0].unionByName(both[1])


@plan("bitmap_xor_andnot", """
WITH a AS (SELECT DISTINCT l_returnflag f, l_orderkey * 1000003 - 7000000000 k FROM lineitem WHERE l_linestatus = 'O'),
b AS (SELECT DISTINCT l_returnflag f, l_orderkey * 1000003 - 7000000000 k FROM lineitem WHERE l_linestatus = 'F')
SELECT f AS flag, 'andnot' AS op, count(*) AS cardinality FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY 1
UNION ALL SELECT f, 'xor', count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY 1
""")
def bitmap_xor_andnot(spark, t):
    """Sparse 64-bit ids, negative ones too."""
    lines = t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_linestatus", (F.col("l_orderkey") * F.lit(1000003).cast("long") - F.lit(7000000000)).alias("id"))
    a = stage(bitmap_build(lines.where("l_linestatus = 'O'"), ["flag"], "id"), "bitmaps")
    b = stage(bitmap_build(lines.where("l_linestatus = 'F'"), ["flag"], "id"), "bitmaps")
    both = [bitmap_cardinality(bitmap_combine(a, b, ["flag"], op), ["flag"]).select("flag", F.lit(op).alias("op"), "cardinality") for op in ("xor", "andnot")]
    return both[0].unionByName(both[1])


@plan("bitmap_contains", """
WITH m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)
SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM m) GROUP BY 1
""")
def bitmap_asked(spark, t):
    """Sets per supplier, united, then asked for every order."""
    sets = bitmap_build(t.lineitem.where("l_quantity > 45"), ["l_suppkey"], "l_orderkey")
    return bitmap_contains(bitmap_rollup(sets, []), t.orders, [], "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


@plan("bucketed_histogram", """
WITH c AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket_start,
                  CASE WHEN value < 0 THEN 0 WHEN value >= 50 THEN 11 ELSE CAST(floor(value / 5) AS BIGINT) + 1 END AS bin, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT b AS bucket_start, i AS bin FROM (SELECT unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 6 HOUR)) AS b FROM c), (SELECT unnest(generate_series(0, 11)) AS i))
SELECT bucket_start, CAST(bin AS BIGINT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS rows FROM s LEFT JOIN c USING (bucket_start, bin)
""")
def histogram(spark, t):
    return bucketed_histogram(t.events, "ts", "6 hours", "value", (0.0, 50.0, 10))


@plan("exact_fraction_sum", """
WITH s AS (SELECT l_suppkey, sum(CAST(l_linenumber AS BIGINT) * (27720 // (1 + CAST(l_quantity AS INT) % 12))) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, CAST(n // gcd(CAST(n AS BIGINT), 27720) AS VARCHAR) AS num, CAST(27720 // gcd(CAST(n AS BIGINT), 27720) AS VARCHAR) AS den FROM s
""")
def exact_fraction_sum(spark, t):
    rows = t.lineitem.select("l_suppkey", F.col("l_linenumber").alias("num"), (1 + F.col("l_quantity").cast("int") % 12).alias("den"))
    return fraction_sum(rows, ["l_suppkey"], "num", "den").select(
        "l_suppkey", F.col("num").cast("string").alias("num"), F.col("den").cast("string").alias("den"))

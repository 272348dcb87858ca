"""Queries over ordered windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.operators.counters import snapshot_delta
from lodework.operators.ordered import framed, nth_from_last, null_safe, numbered, range_framed, running, topk
from lodework.plans.registry import plan

def gaps(t):
    """Events whose value is NULL at every fourth id."""
    return t.events.select("user_id", "ts", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("x"))


def by_time():
    return [F.asc("ts"), F.asc("event_id")]


GAPS_SQL = "SELECT user_id, ts, event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS x FROM events"


@plan("last_value_ignore_nulls", f"""
SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
FROM ({GAPS_SQL})
""")
def last_value_ignore_nulls(spark, t):
    return running(gaps(t), ["user_id"], by_time(), {"filled": ("last", F.col("x"))}).select("event_id", "filled")


@plan("ignore_nulls_family", f"""
WITH g AS ({GAPS_SQL}), third AS (SELECT user_id, x FROM (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM g WHERE x IS NOT NULL) WHERE i = 3)
SELECT g.event_id, first_value(g.x IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.ts, g.event_id ROWS UNBOUNDED PRECEDING) AS first_x,
       lag(g.x IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.ts, g.event_id) AS lag_x,
       lead(g.x IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.ts, g.event_id) AS lead_x, third.x AS third_x
FROM g LEFT JOIN third ON g.user_id = third.user_id
""")
def ignore_nulls_family(spark, t):
    rows = gaps(t)
    back = [F.desc("ts"), F.desc("event_id")]
    df = running(rows, ["user_id"], by_time(), {"first_x": ("first", F.col("x"))})
    df = running(df, ["user_id"], by_time(), {"lag_x": ("last", F.col("x"))}, inclusive=False)
    df = running(df, ["user_id"], back, {"lead_x": ("last", F.col("x"))}, inclusive=False)
    third = (topk(rows.where("x IS NOT NULL"), ["user_id"], by_time(), 3).where("rn = 3")
             .select(F.col("user_id").alias("u"), F.col("x").alias("third_x")))
    return df.join(third, null_safe(df, third, [("user_id", "u")]), "left").select(
        "event_id", "first_x", "lag_x", "lead_x", "third_x")


@plan("nth_from_last", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
SELECT e.event_id, e.user_id, r.value AS second_last FROM events e LEFT JOIN r ON e.user_id = r.user_id AND r.i = 2
""")
def second_from_last(spark, t):
    return nth_from_last(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"],
                         [F.desc("ts"), F.desc("event_id")], "value", 2, "second_last").select(
        "event_id", "user_id", "second_last")


@plan("ranking_frames", """
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, ntile(4) OVER w AS quarter,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS near_total,
       count(*) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS last_30_days
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def ranking_frames(spark, t):
    orders = t.orders.withColumn("day", F.unix_date(F.col("o_orderdate").cast("date")))
    order = [F.asc("o_orderdate"), F.asc("o_orderkey")]
    df = numbered(orders, ["o_custkey"], order, "rn", ntile=("quarter", 4))
    df = numbered(df, ["o_custkey"], [F.asc("o_orderpriority")], row_number=None, rank="rk", dense_rank="dr")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    df = framed(df, ["o_custkey"], order,
                lambda w: {"near_total": F.sum(price).over(w.rowsBetween(-2, 1)).cast("double")}, preceding=2, following=1)
    df = range_framed(df, ["o_custkey"], "day",
                      lambda w: {"last_30_days": F.count(F.lit(1)).over(w.rangeBetween(-30, 0))}, preceding=30)
    return df.select(
        "o_orderkey", "rn", "rk", "dr", "quarter", "near_total", "last_30_days")


SNAPSHOTS_SQL = """
d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2),
s AS (SELECT user_id, day, sum(v) OVER (PARTITION BY user_id, (date_diff('day', DATE '2024-01-01', day) // 10) ORDER BY day) AS total FROM d)
"""


@plan("snapshot_delta", f"""
WITH {SNAPSHOTS_SQL}
SELECT user_id, day, CAST(total AS DOUBLE) AS total,
       CAST(CASE WHEN total < lag(total) OVER w THEN total ELSE total - lag(total) OVER w END AS DOUBLE) AS total_delta
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day)
""")
def snapshot_deltas(spark, t):
    daily = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    epoch = F.floor(F.date_diff("day", F.lit("2024-01-01").cast("date")) / 10)
    snapshots = running(daily.withColumn("reset", epoch), ["user_id", "reset"], [F.asc("day")], {"total": ("sum", F.col("v"))})
    return snapshot_delta(snapshots.select("user_id", "day", F.col("total").cast("decimal(28,2)").alias("total")), ["user_id"], "day", ["total"]).select(
        "user_id", "day", F.col("total").cast("double").alias("total"), F.col("total_delta").cast("double").alias("total_delta"))

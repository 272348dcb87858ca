"""Queries over versioned tables and periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.operators.temporal import apply_changes, coalesce_periods, period_violations
from lodework.plans.registry import plan


@plan("system_versioning", """
WITH c AS (SELECT user_id, event_type AS state, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)
SELECT user_id, state, ts AS valid_from, valid_to, CASE WHEN valid_to IS NULL THEN 'current' ELSE 'history' END AS part FROM c WHERE state <> 'error'
""")
def system_versioning(spark, t):
    changes = t.events.select("user_id", F.col("event_type").alias("state"), "ts", "event_id",
                              F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"))
    first, second = changes.where("ts < timestamp_ntz '2024-01-15'"), changes.where("ts >= timestamp_ntz '2024-01-15'")
    empty = changes.select("user_id", "state", F.col("ts").alias("valid_from")).where("false")
    now, past = apply_changes(empty, empty.withColumn("valid_to", F.col("valid_from")), first, ["user_id"], "ts", "event_id")
    now, past = apply_changes(now, past, second, ["user_id"], "ts", "event_id")
    return (past.withColumn("part", F.lit("history"))
            .unionByName(now.select("*", F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit("current").alias("part"))))


PERIODS_SQL = """p AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(o_orderdate AS DATE) AS f,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 - 2 AS INTEGER) AS u FROM orders)"""


def periods(t):
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("f"),
                           F.expr("date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 90 - 2 AS INT))").alias("u"))


@plan("period_checks", f"""
WITH {PERIODS_SQL},
g AS (SELECT *, max(u) OVER (PARTITION BY k ORDER BY f, u, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p WHERE f < u)
SELECT k, id, f, u, 'inverted' AS violation FROM p WHERE f >= u
UNION ALL SELECT k, id, f, u, CASE WHEN f < b THEN 'overlap' ELSE 'gap' END FROM g WHERE b IS NOT NULL AND f <> b
""")
def period_checks(spark, t):
    return period_violations(periods(t), ["k"], "f", "u", [F.asc("id")])


@plan("period_coalesce", f"""
WITH {PERIODS_SQL}, v AS (SELECT * FROM p WHERE f < u),
g AS (SELECT *, max(u) OVER (PARTITION BY k ORDER BY f, u, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR f > b THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY f, u, id) AS island FROM g)
SELECT k, min(f) AS f, max(u) AS u, count(*) AS periods FROM i GROUP BY k, island
""")
def period_coalesce(spark, t):
    return coalesce_periods(periods(t), ["k"], "f", "u", [F.asc("id")])

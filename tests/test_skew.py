"""Operators built on split windows give the same rows when almost every key counts as hot."""

import pytest
from pyspark.sql import functions as F

from lodework.operators.aggregates import ordered_array
from lodework.operators.counters import snapshot_delta
from lodework.operators.joins import asof_join
from lodework.operators.temporal import apply_changes, coalesce_periods, period_violations
from lodework.plans.temporal import periods
from lodework.session import load_tables
from tests.harness import DATA

SPLIT, WHOLE = 40, 10 ** 9


@pytest.fixture(scope="module")
def t(spark):
    return load_tables(spark, f"{DATA}/sf0.001")


def skewed(events):
    """Events of which two thirds belong to one user."""
    return events.withColumn("user_id", F.when(F.col("event_id") % 3 != 0, 0).otherwise(F.col("user_id")))


def same(make):
    split, whole = (make(n) for n in (SPLIT, WHOLE))
    columns = sorted(split.columns)
    assert columns == sorted(whole.columns)
    left, right = (sorted(map(str, d.select(*columns).collect())) for d in (split, whole))
    assert left == right and left


def test_asof_join(t):
    events = skewed(t.events)
    changes = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("version"))
    same(lambda n: asof_join(events.select("user_id", "ts", "event_id"), changes, ["user_id"], "ts", ["event_id"], ["version"], hot_rows=n))


def test_system_versioning(t):
    changes = skewed(t.events).select("user_id", F.col("event_type").alias("state"), "ts", "event_id",
                                      F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"))
    empty = changes.select("user_id", "state", F.col("ts").alias("valid_from")).where("false")

    def both(n):
        now, past = apply_changes(empty, empty.withColumn("valid_to", F.col("valid_from")), changes, ["user_id"], "ts", "event_id", hot_rows=n)
        return past.unionByName(now.withColumn("valid_to", F.lit(None).cast("timestamp_ntz")))

    same(both)


def test_periods(t):
    rows = periods(t).withColumn("k", F.col("k") % 3)
    same(lambda n: period_violations(rows, ["k"], "f", "u", [F.asc("id")], hot_rows=n))
    same(lambda n: coalesce_periods(rows, ["k"], "f", "u", [F.asc("id")], hot_rows=n))


def test_counters_and_arrays(t):
    events = skewed(t.events)
    same(lambda n: snapshot_delta(events.select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", ["value"], [F.asc("event_id")], hot_rows=n))
    same(lambda n: ordered_array(events, ["user_id"], "event_id", [F.asc("ts"), F.asc("event_id")], 50, hot_rows=n))

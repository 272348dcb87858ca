"""Inputs that once gave wrong rows, wrong types or needless errors."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodework.functions.ids import decode_ids, encode_ids
from lodework.functions.json import json_where, validate_json
from lodework.functions.routines import grouped_agg
from lodework.functions.times import cron_runs, rrule_occurrences
from lodework.operators.joins import asof_join, hinted_join
from lodework.operators.ordered import running
from lodework.operators.privacy import mask
from lodework.operators.ranges import band_join, cidr_bounds, prefix_join
from lodework.operators.tabular import semver_key
from lodework.sources.rows import sample_rows, values_table
from lodework.streaming.feeds import ReplicationSet, apply_feed, parse_changes


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_inline_rows_are_the_small_side(spark):
    names = values_table(spark, [("a", 1), ("b", None)], "k string, n int")
    assert names.schema.simpleString() == "struct<k:string,n:int>" and rows(names) == [("a", 1), ("b", None)]
    assert "LocalTableScan" in plan_of(names) and "ExistingRDD" not in plan_of(names)
    assert values_table(spark, [], "k string").count() == 0


def test_key_changing_update(spark):
    feed = [{"pos": 1, "change": [{"kind": "insert", "table": "t", "names": ["id", "x"], "values": ["1", "old"]},
                                  {"kind": "insert", "table": "t", "names": ["id", "x"], "values": ["2", "stays"]}]},
            {"pos": 2, "change": [{"kind": "update", "table": "t", "names": ["id", "x"], "values": ["7", "new"], "key": {"id": "1"}}]}]
    changes = parse_changes(values_table(spark, [(json.dumps(f),) for f in feed], "value string"))
    subscribed = ReplicationSet().add_table("t", ["id"], "id bigint, x string")
    assert rows(apply_feed(None, changes, "t", subscribed)) == [(2, "stays"), (7, "new")]
    before = values_table(spark, [(1, "old"), (3, "kept")], "id bigint, x string")
    assert rows(apply_feed(before, changes.where("pos = 2"), "t", subscribed)) == [(3, "kept"), (7, "new")]


def test_asof_leaves_null_keys_unmatched(spark):
    left = values_table(spark, [(1, None, 5), (2, "a", 5), (3, "a", None)], "i int, k string, t int")
    right = values_table(spark, [(None, 1, "n"), ("a", 2, "x"), ("a", None, "y")], "k string, t int, v string")
    assert rows(asof_join(left, right, ["k"], "t", ["i"], ["v"]), "i", "v") == [(1, None), (2, "x"), (3, None)]


def test_all_rows_of_a_prefix(spark):
    numbers = values_table(spark, [("491234",), ("3312",)], "n string")
    routes = values_table(spark, [("49", "one"), ("49", "two"), ("4", "far"), ("33", "fr")], "p string, op string")
    assert rows(prefix_join(numbers, routes, "n", "p"), "n", "op") == [("3312", "fr"), ("491234", "one"), ("491234", "two")]


def test_band_join_tests_the_bounds(spark):
    points, bands = values_table(spark, [(1.4,), (1.45,), (2.4,), (-0.2,)], "v double"), values_table(spark, [(1.45, 2.4), (-0.5, 0.0), (3.0, 1.0)], "a double, b double")
    assert rows(band_join(points, bands, "v", F.col("a"), F.col("b"))) == [(-0.2, -0.5, 0.0), (1.45, 1.45, 2.4)]


def test_networks_out_of_range(spark):
    got = values_table(spark, [("10.0.0.0/33",), ("10.0.0.0/8",)], "c string").select(cidr_bounds(F.col("c")).alias("b")).collect()
    assert got[0].b.lo is None and (got[1].b.lo, got[1].b.hi) == (167772160, 184549375)


@pytest.mark.parametrize("rule", ["FREQ=HOURLY", "FREQ=DAILY;BYMONTHDAY=3", "FREQ=MONTHLY;BYDAY=1MO", "COUNT=3", "nonsense"])
def test_unknown_rules_raise(spark, rule):
    table = values_table(spark, [(rule, dt.datetime(2024, 1, 1))], "r string, s timestamp_ntz")
    with pytest.raises(Exception, match="not understood"):
        rrule_occurrences(table, "r", "s", "2024-02-01").collect()


@pytest.mark.parametrize("schedule", ["0 12 * * FUN", "61 * * * *", "* * *", "5- * * * *", "* * * 13 *"])
def test_bad_schedules_raise(spark, schedule):
    with pytest.raises(Exception, match="not understood"):
        cron_runs(values_table(spark, [(schedule,)], "c string"), "c", "2024-01-01", "2024-01-02").collect()


def test_schedule_names(spark):
    due = cron_runs(values_table(spark, [("0 12 * * MON,fri",)], "c string"), "c", "2024-01-01", "2024-01-08")
    assert [r.due.day for r in due.orderBy("due").collect()] == [1, 5]


def test_large_integers_in_json(spark):
    table = values_table(spark, [('{"n":9007199254740993}',), ('{"n":9007199254740992}',), ('{"n":1.5}',)], "j string")
    assert rows(json_where(table, "j", "$.n", "=", 9007199254740992)) == [('{"n":9007199254740992}',)]
    assert json_where(table, "j", "$.n", ">", 1).count() == 3


def test_enum_beyond_ascii(spark):
    table = values_table(spark, [('"é"',), ('{"b":1,"a":[2]}',), ('"e"',)], "j string")
    got = [r.violations for r in validate_json(table, "j", {"enum": ["é", {"a": [2], "b": 1}]}).collect()]
    assert got == [[], [], ["$ enum"]]


def test_large_group_keys_beside_null(spark):
    table = values_table(spark, [(9007199254740993, 1), (9007199254740992, 2), (None, 4), (9007199254740993, 8)], "k bigint, v int").coalesce(1)
    got = grouped_agg(table, ["k"], ["v"], lambda p: int(p["v"].sum()), sum, lambda s: s, "bigint")
    assert rows(got) == [(9007199254740992, 2), (9007199254740993, 9), (None, 4)]


def test_ids_leave_other_columns_alone(spark):
    table = values_table(spark, [(5, "a", "l", "r", "m"), (None, "b", "l", "r", "m")], "n bigint, _id string, _l string, _r string, _m string")
    coded = encode_ids(table, "n", "s")
    assert coded.columns == [*table.columns, "code"] and coded.first().code not in (None, "5")
    assert rows(decode_ids(coded, "code", "s", "back"), "back", "_id", "_l", "_r", "_m") == [(5, "a", "l", "r", "m"), (None, "b", "l", "r", "m")]


def test_only_versions_are_versions(spark):
    texts = [("1.2.3",), ("v1.2.3-rc.1+b7",), ("1.2.3.4",), ("1.2.3foo",), ("01.2.3",), ("1.2",)]
    got = values_table(spark, texts, "v string").select(semver_key(F.col("v")).isNotNull().alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, False, False, False]


def test_sample_with_null_keys(spark):
    table = spark.range(500).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))
    assert rows(sample_rows(table, 120, "id", direct=10)) == rows(sample_rows(table, 120, "id", direct=1000))


def test_types_do_not_change_with_size(spark):
    table = spark.range(300).select(F.lit(1).alias("k"), "id", F.col("id").cast("decimal(18,2)").alias("x"))
    ask = {"s": ("sum", F.col("x")), "n": ("count", F.col("x")), "m": ("max", F.col("x"))}
    small, large = (running(table, ["k"], [F.asc("id")], ask, hot_rows=n) for n in (1000, 50))
    assert small.schema.simpleString() == large.schema.simpleString() and rows(small) == rows(large)


def test_broadcast_is_bounded_in_bytes(spark):
    left, right = spark.range(10), spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert "BroadcastHashJoin" in plan_of(hinted_join(left, right, "id", "broadcast"))
    assert "SortMergeJoin" in hinted_join(left, right, "id", "broadcast", broadcast_bytes=5000)._jdf.queryExecution().sparkPlan().toString()


def test_keyed_masks_need_a_secret(spark):
    with pytest.raises(ValueError, match="secret"):
        mask(spark.range(1), {"id": ("hash",)})

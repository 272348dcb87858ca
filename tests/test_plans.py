"""Physical plans: what reaches the scan, what is joined how, what is cut before a shuffle."""

import pytest
from pyspark.sql import functions as F

from lodework.operators.joins import hinted_join
from lodework.operators.ordered import topk
from lodework.operators.search import build_bm25, bm25_topk
from lodework.plans import PLANS
from lodework.session import load_tables
from tests.harness import DATA

SMALL = f"{DATA}/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return load_tables(spark, SMALL)


def test_scan_is_pruned(spark):
    plan = physical(PLANS["scan_parquet"].run(spark, SMALL))
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_topk_is_cut_before_the_shuffle(t):
    assert physical(topk(t.orders, ["o_custkey"], [F.desc("o_totalprice")], 3)).count("WindowGroupLimit") == 2


def test_sort_limit_is_one_operator(spark):
    assert "TakeOrderedAndProject" in physical(PLANS["sort_limit"].run(spark, SMALL))


@pytest.mark.parametrize("strategy,operator", [("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin")])
def test_hints_choose_the_join(t, strategy, operator):
    on = F.col("o_custkey") == F.col("c_custkey")
    assert operator in physical(hinted_join(t.orders, t.customer, on, strategy))


def test_broadcast_hint_checks_the_size(t):
    on = F.col("o_custkey") == F.col("c_custkey")
    assert "SortMergeJoin" in physical(hinted_join(t.orders, t.customer, on, "broadcast", broadcast_rows=10))


def test_search_terms_reach_the_postings(spark, t):
    plan = physical(bm25_topk(build_bm25(t.documents, "doc_id", "text"), "hention", 3))
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and "block" in line.split("ReadSchema")[1]]
    assert pushed and all("EqualTo(term,hention)" in line.split("PushedFilters")[1] for line in pushed)


def test_filters_reach_the_partitions(spark, t):
    from lodework.session import scratch_path
    from lodework.sources.files import write_partitioned

    path = scratch_path(spark, "pruned")
    part = write_partitioned(t.events, path, "ts", "day")
    plan = physical(spark.read.parquet(path).where(F.col(part) == F.lit("2024-01-05").cast("date")))
    assert "PartitionFilters: [isnotnull(ts_day" in plan


@pytest.mark.parametrize("name", ["fold_ascii", "char_inventory", "json_path", "doc_insert_find", "bigram_search"])
def test_text_is_not_dealt_out_first(spark, name):
    """However few files a table has, its rows are worked on where they are read."""
    assert "RoundRobin" not in physical(PLANS[name].run(spark, SMALL))


def test_no_fixed_task_counts():
    import pathlib
    import re

    import lodework

    for path in pathlib.Path(lodework.__file__).parent.rglob("*.py"):
        text = path.read_text()
        assert not re.search(r"(repartition|coalesce)\((?!1\))\d+[,)]|inputFiles", text), path


def test_inline_rows_are_broadcast(spark):
    plan = physical(PLANS["inline_values"].run(spark, SMALL))
    small = plan.split("BroadcastExchange")[1]
    assert "LocalTableScan" in small and "lineitem" not in small.split("LocalTableScan")[0]


def test_bigram_texts_are_tested_after_the_join(spark):
    df = PLANS["bigram_search"].run(spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (Contains(text" in plan and "Filter Contains(text" not in plan

"""Steps whose work may not grow faster than their input, against brute force."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodework.functions import routines
from lodework.llm import decontaminate
from lodework.operators import bitmaps, geo, ranges, search, sketches


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_asked_numbers_meet_words_and_not_containers(spark):
    held = bitmaps.bitmap_build(spark.range(0, 300_000, 3).selectExpr("id % 2 AS k", "id - 1000 AS x"), ["k"], "x")
    asked = spark.range(0, 200_000, 7).selectExpr("id % 2 AS k", "id - 5000 AS y", "'a' AS high")
    found = bitmaps.bitmap_contains(held, asked.unionByName(asked), ["k"], "y")
    want = [(n % 2, n - 5000) for n in range(0, 200_000, 7) if (m := n - 4000) >= 0 and m % 3 == 0 and m % 2 == n % 2]
    assert sorted((r.k, r.y) for r in found.collect()) == sorted(want * 2) and found.columns == ["k", "y", "high"]
    assert "ArrowEvalPython" not in plan_of(found)


def test_digest_of_a_long_task(spark):
    """More rows than a task gathers before it merges."""
    rows = spark.range(600_000).coalesce(1).selectExpr("id % 3 AS k", "CAST(id AS double) AS x")
    found = {(r.k, r.p): r.quantile for r in sketches.tdigest_read(sketches.tdigest_build(rows, ["k"], "x"), [0.0, 0.5, 1.0]).collect()}
    for k in range(3):
        assert found[k, 0.0] == k and found[k, 1.0] == 599_997 + k and abs(found[k, 0.5] - 300_000) < 6000


def test_frequencies_of_all_documents(spark):
    docs = spark.createDataFrame([(i, f"alpha beta number{i} gamma delta") for i in range(50)] + [(None, None)], "doc_id long, text string")
    items = decontaminate.test_items(spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"), "item_id", "text", 0.8)
    sizes = [r.size for r in items.select("size").collect()]
    times = {r.key: r.times for r in decontaminate.frequencies(docs, items, sizes, "doc_id", "text").collect()}
    known = decontaminate.word_cache()
    keys = decontaminate.keys_of(decontaminate.hashes_of(["alpha", "beta", "gamma", "delta"], known), sizes[0]).view("int64").tolist()
    every = {k: 50 for k in (keys if sizes[0] == 1 else [keys[0], keys[2]])}
    assert {k: times[k] for k in every} == every


def test_states_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(routines, "GATHER_ROWS", 1000)
    table = spark.range(60_000).coalesce(1).selectExpr("id * 7919 % 60 AS k", "id AS v")
    states = routines.grouped_agg(table, ["k"], ["v"], lambda p: (1, int(p["v"].sum())), lambda s: tuple(map(sum, zip(*s))), list, "array<bigint>", "out").collect()
    total = {k: sum(i for i in range(60_000) if i * 7919 % 60 == k) for k in range(60)}
    assert {r.k: r.out[1] for r in states} == total
    assert sum(r.out[0] for r in states) <= 60 * 16 + 120  # was one a group for each 1000 rows


def test_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(geo, "PAIRS", 500)
    r = random.Random(4)
    a = [(i, r.choice([0.0, r.uniform(-2, 2)]), r.choice([0.0, r.uniform(-2, 2)])) for i in range(250)] + [(900, None, 0.0), (901, 0.0, 0.0), (901, 0.0, 0.0)]
    b = [(j, r.uniform(-1, 1), r.uniform(-1, 1)) for j in range(120)] + [(900, 0.0, None)]
    found = geo.dwithin_join(spark.createDataFrame(a, "i long, ax double, ay double"), spark.createDataFrame(b, "j long, bx double, by double"), "ax", "ay", "bx", "by", 0.5)
    want = sorted((i, j) for i, x, y in a for j, u, v in b if None not in (x, y, u, v) and (x - u) ** 2 + (y - v) ** 2 <= 0.25)
    assert sorted((p.i, p.j) for p in found.collect()) == want
    assert "_as" in plan_of(found)


@pytest.mark.parametrize("few", [3, 64])
def test_periods_of_few_and_of_many(spark, monkeypatch, few):
    monkeypatch.setattr(ranges, "FEW", few)
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), i, r.randint(0, 60), r.choice([None, r.randint(0, 60)])) for i in range(120)]
    days = "CAST(date_add(DATE'2024-01-01', {0}) AS date)"
    p = spark.createDataFrame(rows, "k long, id long, f int, u int").selectExpr("k", "id", days.format("f") + " AS f", days.format("u") + " AS u")
    got = ranges.interval_join(p.toDF("k", "a", "lf", "lu"), p.toDF("k", "b", "rf", "ru"), "lf", "lu", "rf", "ru", ["k"])
    end = lambda u: 10 ** 6 if u is None else u
    want = sorted((a, b) for k, a, f, u in rows for m, b, g, v in rows if k is not None and k == m and f < end(u) and g < end(v) and f < end(v) and g < end(u))
    assert sorted((x.a, x.b) for x in got.collect()) == want
    assert ("range_blocks" in str(got) or "explode" in plan_of(got)) == (few == 3)


def test_spans_are_filed_in_two_blocks(spark, monkeypatch):
    filed = []
    join = ranges._blocks_join
    monkeypatch.setattr(ranges, "_blocks_join", lambda a, cut, *rest: filed.append(cut.count()) or join(a, cut, *rest))
    spans = spark.createDataFrame([("2001:db8:1::7", "2001:db8:9::1:3"), ("::1", "::1"), ("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), ("::2", "::1")], "x string, y string")
    points = spark.createDataFrame([("2001:db8:1::6",), ("2001:db8:1::7",), ("2001:db8:9::1:3",), ("2001:db8:9::1:4",), ("::1",)], "ip string")
    got = sorted((r.ip, r.x) for r in ranges.ipv6_range_join(points, spans, "ip", "x", "y").collect())
    every = ["2001:db8:1::6", "2001:db8:1::7", "2001:db8:9::1:3", "2001:db8:9::1:4", "::1"]
    assert got == sorted([(ip, "::") for ip in every] + [("2001:db8:1::7", "2001:db8:1::7"), ("2001:db8:9::1:3", "2001:db8:1::7"), ("::1", "::1")])
    assert filed[0] <= 6


def test_postings_are_dealt_out_once(spark):
    """Rows that share an id, NULL ids too, are one text; words are counted before they leave their task."""
    rows = [(1, "b q q"), (1, "q c"), (None, "q"), (None, "q b"), (2, None), (3, "")] + [(i, "d") for i in range(10, 700)]
    index = search.build_bm25(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text")
    entries = {(r.term, r.id): (r.tf, r.len) for r in index.blocks.selectExpr("term", "inline(entries)").collect()}
    assert {k: v for k, v in entries.items() if k[0] != "d"} == {("b", 1): (1, 3), ("c", 1): (1, 2), ("q", 1): (3, 3), ("q", None): (2, 2), ("b", None): (1, 2)} and len(entries) == 5 + 690
    assert {r.term: (r.df, r.total_tf, r.bits) for r in index.terms.collect()} == {"b": (2, 2, 0), "q": (2, 5, 0), "c": (1, 1, 0), "d": (690, 690, 3)}
    assert "total_tf" in index.blocks.columns and index.blocks.agg(F.sum("total_tf")).first()[0] == index.total_length
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([["x", "y", "x"], None])], ["id", "words"])
    assert [b.to_pylist() for b in search._counted([batch])] == [[{"id": 7, "term": "x", "tf": 2, "len": 3}, {"id": 7, "term": "y", "tf": 1, "len": 3}]]


def test_outer_joins_share_one_count(spark):
    """The joins read the staged counts, whose size the planner knows, and do not group the orders anew."""
    from lodework.plans import PLANS
    from tests.harness import DATA

    made = PLANS["join_outer"].run(spark, f"{DATA}/sf0.001")
    assert "o_custkey" not in plan_of(made)
    assert {r.kind for r in made.select("kind").distinct().collect()} == {"left", "right", "full"}


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_addresses_meet_networks_in_pages(spark, monkeypatch, threshold):
    monkeypatch.setattr(ranges, "PAGE", 7)
    monkeypatch.setattr(ranges, "_pages", lambda *a, f=ranges._pages: packed.append(f(*a)) or packed[-1])
    packed = []
    r = random.Random(6)
    ips = [(i, r.choice([5, 5, 70, r.randint(-300, 900), None]), str(i)) for i in range(400)] + [(0, 5, "0")] * 20
    nets = [(i, lo, lo + r.choice([0, 3, 63, 200, -1])) for i in range(60) for lo in [r.randint(-200, 800)]] * 2 + [(90, None, 5), (91, 4, None), (92, 5, 5)] + [(100 + i, 4, 5) for i in range(20)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        a = spark.createDataFrame(ips, "id long, ip long, name string").repartition(3)
        found = ranges.cidr_join(a, spark.createDataFrame(nets, "net int, lo long, hi long"))
        got = sorted((x.id, x.ip, x.name, x.net) for x in found.collect())
        assert found.columns == ["id", "ip", "name", "net", "lo", "hi"] and found.schema["net"].dataType.simpleString() == "int"
        assert got == sorted((i, ip, name, net) for i, ip, name in ips for net, lo, hi in nets if None not in (ip, lo, hi) and lo <= ip <= hi)
        assert [p.agg(F.max(F.size(p.columns[2]))).first()[0] for p in packed[:2]] == [7, 7]
        assert ranges.cidr_join(a.where("id < 0"), spark.createDataFrame(nets, "net int, lo long, hi long")).isEmpty()
        assert ranges.cidr_join(a, spark.createDataFrame([], "net int, lo long, hi long")).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("threshold", "addresses", "networks"), [("100m", 20_000, 150), ("100m", 100_000, 30), ("-1", 20_000, 150)])
def test_answer_of_crowded_networks_is_small(spark, tmp_path, threshold, addresses, networks):
    """Blocks of many networks, addresses in any order: 3 million rows, whichever side is sent to all tasks."""
    blocks = addresses // 75
    a = spark.range(0, addresses, 1, 2).selectExpr("id", f"(id * 2654435761) % {blocks} * 256 + id % 256 AS ip")
    n = spark.range(blocks * networks).selectExpr("id AS net", f"id % {blocks} * 256 AS lo", f"id % {blocks} * 256 + 255 AS hi")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        ranges.cidr_join(a, n).select("id", "ip", "net").write.parquet(str(tmp_path / "met"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.read.parquet(str(tmp_path / "met")).count() == 3_000_000
    written = sum(p.stat().st_size for p in (tmp_path / "met").glob("*.parquet"))
    assert written < 3_000_000

"""Known values of single operators on small literal inputs."""

import datetime as dt
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from lodework.functions.ids import decode_ids, encode_ids
from lodework.functions.json import json_matches_schema, json_where, nest, validate_json
from lodework.functions.regex import regex_count, regex_extract, regex_filter
from lodework.functions.routines import register_scalar
from lodework.functions.text import char_inventory, fold_ascii
from lodework.functions.times import (cron_runs, from_nanos, rrule_occurrences, schedule_job, to_nanos, unschedule_job,
                                      uuid7, uuid7_floor, uuid7_ts)
from lodework.operators import aggregates, bitmaps, collections, geo, graph, ranges, search, similarity, sketches, tabular, vectors
from lodework.operators.ordered import running
from lodework.operators.privacy import decrypt, encrypt, mask
from lodework.operators.quality import check_value, run_checks
from lodework.sources.files import compact, partition_registry, read_files, retain, write_partitioned
from lodework.sources.remote import jdbc_options
from lodework.sources.rows import csv_agg, run_sql, sample_rows, series, values_table
from lodework.streaming.queues import OPS, archive, drop_queue, expired_reads, queue_state, read, send
from lodework.streaming.views import (compact_view, incremental_view, read_view, refresh_groups, run_to_end, signed_view,
                                      time_bucket_agg)
from lodework.session import scratch_path


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ints(spark, lo, hi):
    return series(spark, lo, hi, name="g").withColumn("k", F.lit(1))


# --- sources -----------------------------------------------------------------

def test_series_and_values(spark):
    assert [r[0] for r in series(spark, 5, 1, -2).collect()] == [5, 3, 1]
    assert values_table(spark, [(1, "a")], "id int, name string").first() == (1, "a")
    df = spark.range(3)
    assert run_sql(spark, "SELECT count(*) FROM {t} WHERE id >= :low", {"low": 1}, {"t": df}).first()[0] == 2


def test_csv_agg(spark):
    rows = values_table(spark, [(1, "a"), (2, "b")], "id int, name string").withColumn("g", F.lit(1))
    assert csv_agg(rows, ["g"], ["id", "name"], [F.asc("id")], header=True).first()["csv"] == "id,name\n1,a\n2,b"


def test_large_sample_is_exact(spark):
    df = spark.range(5000)
    direct = {r[0] for r in sample_rows(df, 700, "id").collect()}
    cut = {r[0] for r in sample_rows(df, 700, "id", direct=10).collect()}
    assert direct == cut and len(cut) == 700


def test_jdbc_options():
    made = jdbc_options("jdbc:x", "t", partition_col="id", bounds=(1, 100), n=8)
    assert made["dbtable"] == "t" and made["numPartitions"] == "8" and made["pushDownPredicate"] == "true"
    assert jdbc_options("jdbc:x", query="SELECT 1")["query"] == "SELECT 1"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition_col="id")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x")


def test_bad_rows_are_kept_or_refused(spark):
    path = scratch_path(spark, "dirty")
    values_table(spark, [("1,a",), ("x,b",)], "value string").write.text(path)
    kept = read_files(spark, path, "csv", "id int, name string", keep_bad=True).cache()
    assert [(r["id"], r["_corrupt_record"]) for r in kept.orderBy("name").collect()] == [(1, None), (None, "x,b")]
    with pytest.raises(Exception):
        read_files(spark, path, "csv", "id int, name string").collect()


def test_only_written_partitions_change(spark):
    path = scratch_path(spark, "by-day")

    def rows(*items):
        return values_table(spark, [(i, dt.datetime(2024, 1, d)) for i, d in items], "id int, at timestamp_ntz")

    part = write_partitioned(rows((1, 1), (2, 2), (3, 3)), path, "at", "day")
    write_partitioned(rows((9, 2)), path, "at", "day")
    assert sorted(r[0] for r in spark.read.parquet(path).select("id").collect()) == [1, 3, 9]
    listed = {str(r[0]): r[1] for r in partition_registry(spark, path, part, premake=2).collect()}
    assert listed == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-03": 1, "2024-01-04": 0, "2024-01-05": 0}
    assert retain(spark, path, part, keep=1).where("dropped").count() == 2
    assert spark.read.parquet(path).count() == 3  # a dry run changes nothing
    retain(spark, path, part, keep=1, dry_run=False)
    assert [r[0] for r in spark.read.parquet(path).select("id").collect()] == [3]


def test_compaction_leaves_few_sorted_files(spark):
    path, out = scratch_path(spark, "many"), scratch_path(spark, "few")
    spark.range(1000).where("id % 2 = 1").repartition(20).write.parquet(path)
    small = compact(spark, path, out, ["id"], target_rows=300)
    assert len(small.inputFiles()) == 2 and small.count() == 500


# --- regex, scalars ----------------------------------------------------------

def test_regex(spark):
    urls = values_table(spark, [("http://a.com",), ("https://b.org",), ("ftp://c.net",)], "u string")
    assert regex_filter(urls, "u", "^https?://").count() == 2
    t = values_table(spark, [("2024-08-12", "a1b2c3", "abc123")], "d string, c string, p string")
    row = regex_count(regex_extract(regex_extract(t, "d", r"(\d{4})", 1, "y"), "p", r"(\d+)", 1, "n"), "c", r"\d", "m").first()
    assert (row["y"], row["n"], row["m"]) == ("2024", "123", 3)


def test_compat_scalars(spark):
    row = one(spark, F.nvl(F.lit(None).cast("string"), F.lit("spare")), F.expr("decode('red', 'blue', 10, 'red', 20, 30)"),
              F.lpad(F.lit("oak"), 7, "-"), F.last_day(F.lit("2026-02-15").cast("date")), F.day(F.lit("2020-03-15").cast("date")),
              F.months_between(F.lit("2020-03-15").cast("date"), F.lit("2020-01-15").cast("date")))
    assert tuple(row) == ("spare", 20, "----oak", dt.date(2026, 2, 28), 15, 2.0)


def test_folding_and_names(spark):
    assert one(spark, fold_ascii(F.lit("ÆÉßø Łódź")))[0] == "AEEsso Lodz"
    names = {r["char"]: r["char_name"] for r in char_inventory(values_table(spark, [("AA",)], "t string"), "t").collect()}
    assert names == {"A": "LATIN CAPITAL LETTER A"}


def rule(spark, text, start="2020-01-01 00:00:00", horizon="2030-01-01"):
    df = values_table(spark, [(text, start)], "r string, s string").withColumn("s", F.col("s").cast("timestamp_ntz"))
    return [r["occurrence"] for r in rrule_occurrences(df, "r", "s", horizon).orderBy("seq").collect()]


def test_recurrence(spark):
    assert rule(spark, "FREQ=DAILY;COUNT=3") == [dt.datetime(2020, 1, d) for d in (1, 2, 3)]
    assert rule(spark, "FREQ=MONTHLY;COUNT=3", "2020-01-31 09:00:00") == [dt.datetime(2020, m, 31, 9) for m in (1, 3, 5)]
    assert rule(spark, "FREQ=YEARLY;COUNT=2", "2020-02-29 00:00:00") == [dt.datetime(2020, 2, 29), dt.datetime(2024, 2, 29)]
    assert rule(spark, "FREQ=WEEKLY;BYDAY=TU,TH;UNTIL=20200110T000000Z") == [dt.datetime(2020, 1, d) for d in (2, 7, 9)]
    assert rule(spark, "FREQ=DAILY;UNTIL=20200102T000000") == [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)]
    assert rule(spark, "FREQ=DAILY;COUNT=3", horizon="2019-01-01") == []


def test_cron(spark):
    jobs = spark.createDataFrame([], "jobname string, schedule string, command string")
    jobs = schedule_job(jobs, "rotate-logs", "10,40 6-7 * jan MON", "CALL rotate()")
    assert jobs.count() == 1
    due = [r["due"] for r in cron_runs(jobs, "schedule", "2024-01-01 06:30:00", "2024-01-08 06:11:00").orderBy("due").collect()]
    assert due == [dt.datetime(2024, 1, 1, 6, 40), dt.datetime(2024, 1, 1, 7, 10), dt.datetime(2024, 1, 1, 7, 40), dt.datetime(2024, 1, 8, 6, 10)]
    assert unschedule_job(jobs, "rotate-logs").count() == 0


def test_nanos_and_ids(spark):
    ts = F.lit("2020-01-01 12:00:00").cast("timestamp_ntz")
    assert one(spark, from_nanos(to_nanos(ts, 999)))[0] == dt.datetime(2020, 1, 1, 12)
    early, late, back = one(spark, uuid7(ts, F.lit(1)), uuid7(ts + F.expr("interval 1 second"), F.lit(0)), uuid7_ts(uuid7(ts, F.lit(1))))
    assert early < late and len(early) == 36 and back == dt.datetime(2020, 1, 1, 12)
    assert uuid7_floor(dt.datetime(2020, 1, 1, 12)) <= early < uuid7_floor(dt.datetime(2020, 1, 1, 12, 0, 1))


def test_short_ids(spark):
    ids = values_table(spark, [(0,), (42,), (2 ** 62 - 1,), (None,)], "id long")
    rows = decode_ids(encode_ids(ids, "id", "salt"), "code", "salt", "back").collect()
    assert all(r["id"] == r["back"] for r in rows)
    with pytest.raises(Exception, match="out of range"):
        encode_ids(values_table(spark, [(-1,)], "id long"), "id", "salt").collect()


# --- JSON and documents ------------------------------------------------------

def test_json_paths(spark):
    docs = values_table(spark, [('{"size":4,"tint":"teal"}',), ('{"size":7}',), ('{"size":{"depth":12}}',), ("broken",)], "j string")
    assert json_where(docs, "j", "$.size", "=", 4).count() == 1
    assert json_where(docs, "j", "$.size.depth", "=", 12).count() == 1
    assert json_where(docs, "j", "$.size", "=", 9).count() == 0
    assert json_where(docs, "j", "$.tint", "=", "teal").count() == 1
    assert json_where(docs, "j", "$.size", "exists").count() == 3


def test_json_schema(spark):
    def valid(schema, text):
        return json_matches_schema(values_table(spark, [(text,)], "j string"), "j", schema).first()["valid"]

    assert valid({"type": "object", "properties": {"river": {"type": "string"}}}, '{"river": "Isar"}')
    assert not valid({"type": "object", "properties": {"depth": {"type": "integer"}}}, '{"depth": "two metres"}')
    wide = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {
        "n": {"type": "array", "minItems": 1, "items": {"type": "integer", "minimum": 2}},
        "s": {"type": "string", "pattern": "^a", "maxLength": 3}, "e": {"enum": ["x", 1]}}}
    assert valid(wide, '{"n": [2, 3], "s": "abc", "e": 1}')
    texts = ['{"n": [1]}', '{"n": []}', '{"s": "abcd"}', '{"n": [2], "z": 0}', '{"n": [2], "e": "y"}', "nothing"]
    broken = [sorted(r[0]) for r in validate_json(values_table(spark, [(t,) for t in texts], "j string"), "j", wide)
              .select("violations").collect()]
    assert sorted(broken) == sorted([["$.n items"], ["$.n minItems"], ["$ required n", "$.s maxLength"], ["$ additionalProperties"],
                                     ["$.e enum"], ["$ json"]])


def test_nested_documents(spark):
    parents = values_table(spark, [(1, "p"), (2, "q")], "id int, name string")
    children = values_table(spark, [(1, 10), (1, 11)], "fk int, c int")
    got = {(r[0], r[1]): r[2] for r in nest(parents, children, "id", "fk", [F.asc("c")], "kids").collect()}
    assert got == {(1, 0): '{"id":1,"name":"p","kids":[{"c":10},{"c":11}]}', (2, 0): '{"id":2,"name":"q","kids":[]}'}


def test_collection(spark):
    parts = collections.documents(spark, [
        {"_id": "v1", "part": "valve", "bar": 16, "ports": ["in", "out", "drain"]}, {"_id": "p1", "part": "pump", "bar": 9.5},
        {"_id": "p2", "part": "pump", "bar": 100}, {"_id": "g1", "part": "gauge", "unit": "kPa"}])
    assert collections.find(parts, {"part": "valve"}).count() == 1
    assert collections.count_documents(parts, {"bar": {"$gte": 16}}) == 2
    assert collections.count_documents(parts, {"$or": [{"part": "gauge"}, {"bar": {"$lt": 10}}]}) == 2
    assert collections.count_documents(parts, {"ports": ["in", "out", "drain"]}) == 1
    tested = collections.update(parts, {"part": "pump"}, {"$set": {"bar": 12, "tested.by": "bench 4"}}, one=True)
    assert [r["_id"] for r in collections.find(tested, {"bar": 12, "tested.by": "bench 4"}).collect()] == ["p1"]
    assert collections.count_documents(collections.delete(tested, {"part": "pump"})) == 2
    mean = collections.aggregate(parts, [{"$match": {"bar": {"$gt": 10}}}, {"$group": {"_id": None, "mean": {"$avg": "$bar"}}}])
    assert mean.first()["mean"] == 58.0
    # numbers sort by value, whatever their texts
    assert [r["_id"] for r in collections.aggregate(parts, [{"$sort": {"bar": -1}}, {"$limit": 3}]).collect()] == ["p2", "v1", "p1"]
    assert collections.aggregate(parts, [{"$sort": {"bar": 1}}, {"$limit": 1}]).first()["_id"] == "g1"
    ends = collections.aggregate(parts, [{"$group": {"_id": "$part", "lo": {"$min": "$bar"}, "unit": {"$max": "$unit"}}}, {"$sort": {"lo": -1}}])
    assert [(r["_id"], str(r["lo"]), r["unit"] and r["unit"].toPython()) for r in ends.collect()] == [("valve", "16", None), ("pump", "9.5", None), ("gauge", "None", "kPa")]
    low = collections.aggregate(parts, [{"$project": {"bar": 1}}, {"$match": {"bar": {"$lt": 20}}}, {"$sort": {"bar": 1}}])
    assert [(r["_id"], r["bar"].toPython()) for r in low.collect()] == [("p1", 9.5), ("v1", 16)]
    assert one(spark, collections.same_document(F.parse_json(F.lit('{"a":1,"b":2}')), F.parse_json(F.lit('{"b":2,"a":1}'))))[0]
    with pytest.raises(ValueError, match="duplicate"):
        collections.insert(parts, collections.documents(spark, [{"_id": "g1", "part": "clamp"}]))


# --- aggregates and sketches -------------------------------------------------

def test_running_last(spark):
    rows = values_table(spark, [(1, 10), (2, None)], "id int, x int")
    got = running(rows, [], [F.asc("id")], {"last": ("last", F.col("x"))}).orderBy("id").collect()
    assert [r["last"] for r in got] == [10, 10]


def test_first_last(spark):
    rows = values_table(spark, [(1, 30), (1, 10), (1, 20)], "k int, x int")
    assert tuple(aggregates.first_last(rows, ["k"], "x", ["x"]).first())[1:] == (10, 30)


def test_hll(spark):
    assert abs(sketches.hll_count(ints(spark, 1, 1000), ["k"], "g").first()["estimate"] - 1000) < 50
    a, b = (sketches.hll_build(ints(spark, lo, hi), ["k"], "g") for lo, hi in ((1, 500), (400, 900)))
    assert 800 <= sketches.hll_estimate(sketches.hll_pair_union(a, b, ["k"])).first()["estimate"] <= 1000


def test_quantiles(spark):
    got = {r["p"]: r["quantile"] for r in sketches.quantiles(ints(spark, 1, 1000), ["k"], "g", [0.5, 0.99]).collect()}
    assert abs(got[0.5] - 500) < 20 and got[0.99] > 980
    kept = sketches.quantile_build(ints(spark, 1, 1000), ["k"], "g")
    assert abs(sketches.quantile_read(kept, [0.5]).first()["quantile"] - 500) < 20


def test_bitmaps(spark):
    def built(values):
        return bitmaps.bitmap_build(values_table(spark, [(1, v) for v in values], "k int, x int"), ["k"], "x")

    def size(b):
        return bitmaps.bitmap_cardinality(b, ["k"]).first()["cardinality"]

    assert size(built([1, 2, 3, 4, 5, 5])) == 5
    assert size(bitmaps.bitmap_combine(built([1, 2, 3]), built([2, 3, 4]), ["k"], "and")) == 2
    assert size(bitmaps.bitmap_combine(built([1, 2, 3]), built([3, 4, 5]), ["k"], "or")) == 5
    assert bitmaps.bitmap_cardinality(bitmaps.bitmap_combine(built([1]), built([90000]), ["k"], "and"), ["k"]).count() == 0


def test_fractions(spark):
    def total(*pairs):
        df = values_table(spark, [(1, n, d) for n, d in pairs], "k int, n long, d long")
        row = aggregates.fraction_sum(df, ["k"], "n", "d").first()
        return int(row["num"]), int(row["den"])

    assert total((1, 3), (1, 6)) == (1, 2)
    assert total((2, 4)) == total((1, 2)) == (1, 2)
    assert total((1, 2), (-1, 2)) == (0, 1)
    assert total((1, -3)) == (-1, 3)
    third, half = (F.struct(F.lit(1).cast("decimal(38,0)").alias("num"), F.lit(d).cast("decimal(38,0)").alias("den")) for d in (3, 2))
    assert one(spark, aggregates.fraction_less(third, half))[0]
    with pytest.raises(Exception, match="zero denominator"):
        total((1, 0))
    with pytest.raises(Exception):
        total((10 ** 17, 10 ** 18 - 11), (1, 10 ** 18 - 33), (1, 10 ** 18 - 59))


# --- order, joins ------------------------------------------------------------

def test_semver(spark):
    versions = ["1.0.0", "0.9.0", "1.1.0", "1.0.0-rc.1", "1.0.0-rc.10", "1.0.0-rc.2", "1.0.0-alpha", "1.0.0-alpha.1", "bad"]
    df = values_table(spark, [(v,) for v in versions], "v string")
    got = [r[0] for r in df.where(tabular.semver_key(F.col("v")).isNotNull()).orderBy(tabular.semver_key(F.col("v"))).collect()]
    assert got == ["0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-rc.1", "1.0.0-rc.2", "1.0.0-rc.10", "1.0.0", "1.1.0"]
    named = values_table(spark, [("a", "1.0.0"), ("b", "2.3.4"), ("c", "0.5.1")], "n string, v string")
    assert named.where(tabular.semver_key(F.col("v")) >= tabular.semver_key(F.lit("1.0.0"))).count() == 2


def test_networks(spark):
    nets = values_table(spark, [(1, "10.0.0.0/24"), (2, "172.16.0.0/16"), (3, "192.168.1.0/24")], "id int, net string")
    nets = nets.select("id", F.inline(F.array(ranges.cidr_bounds(F.col("net")))))
    ips = values_table(spark, [("172.16.5.10",)], "t string").withColumn("ip", ranges.address_number(F.col("t")))
    assert [r["id"] for r in ranges.cidr_join(ips, nets).collect()] == [2]
    assert one(spark, ranges.address_number(F.lit("256.1.1.1")))[0] is None
    assert one(spark, ranges.ranges_overlap(F.lit(1), F.lit(5), F.lit(5), F.lit(9)))[0]


def test_ipv6(spark):
    ips = values_table(spark, [("2001:db8::1",), ("fe80::1",)], "t string").withColumn("bits", ranges.ipv6_bits(F.col("t")))
    nets = values_table(spark, [("2001:db8::/32", 32), ("2001:db8:0:0::/64", 64)], "net string, len int").withColumn(
        "prefix", F.left(ranges.ipv6_bits(F.col("net")), F.col("len")))
    assert ips.select(F.length("bits")).distinct().collect()[0][0] == 128
    assert [(r["t"], r["net"]) for r in ranges.prefix_join(ips, nets, "bits", "prefix").collect()] == [("2001:db8::1", "2001:db8:0:0::/64")]
    assert ranges.prefix_join(ips, nets, "bits", "prefix", longest=False).count() == 2


def test_prefixes(spark):
    numbers = values_table(spark, [("3312345",), ("3399999",), ("44",), ("1234567890",)], "n string")
    routes = values_table(spark, [("33",), ("331",), ("332",), ("123",)], "p string")
    got = {r["n"]: r["p"] for r in ranges.prefix_join(numbers, routes, "n", "p").collect()}
    assert got == {"3312345": "331", "3399999": "33", "1234567890": "123"}


def test_range_join_against_brute_force(spark):
    points = [(i, (i * 37) % 101 - 50) for i in range(80)]
    spans = [(i, (i * 13) % 90 - 50, (i * 13) % 90 - 50 + (i * 7) % 33 - 2) for i in range(60)]
    p = values_table(spark, points, "pid int, v long")
    r = values_table(spark, spans, "rid int, lo long, hi long")
    got = sorted((x["pid"], x["rid"]) for x in ranges.range_join(p, r, "v", "lo", "hi").collect())
    assert got == sorted((a, b) for a, v in points for b, lo, hi in spans if lo <= v <= hi)
    inside = {a for a, _ in got}
    assert {x["pid"] for x in ranges.range_join(p, r, "v", "lo", "hi", how="left_anti").collect()} == {a for a, _ in points} - inside


def test_interval_join_against_brute_force(spark):
    def day(n):
        return dt.date(2024, 1, 1) + dt.timedelta(days=n)

    left = [(i, i % 3, day(i * 5 % 60), day(i * 5 % 60 + i % 11)) for i in range(40)]
    right = [(i, i % 3, day(i * 7 % 60), None if i % 9 == 0 else day(i * 7 % 60 + i % 17)) for i in range(40)]
    a = values_table(spark, left, "l int, k int, lf date, lt date")
    b = values_table(spark, right, "r int, k int, rf date, rt date")
    got = sorted((x["l"], x["r"]) for x in ranges.interval_join(a, b, "lf", "lt", "rf", "rt", ["k"]).collect())
    far = day(100000)
    want = sorted((i, j) for i, k, f, u in left for j, m, g, v in right
                  if k == m and f < u and g < (v or far) and f < (v or far) and g < u)
    assert got == want and want


# --- text --------------------------------------------------------------------

DOCS = [(1, "Spreadsheet about granite"), (2, "granite ridges and granite scree"), (3, "cooking pasta at home"),
        (4, "full text search with a bigram index")]


def test_bm25_and_match(spark):
    df = values_table(spark, DOCS, "id long, body string")
    ranked = search.bm25_topk(search.build_bm25(df, "id", "body"), "granite scree", 3).collect()
    assert ranked[0]["id"] == 2 and ranked[0]["distance"] < ranked[1]["distance"] < 0
    index = search.build_positions(df, "id", "body")
    assert [r["id"] for r in search.fts(index, ["Spreadsheet"]).collect()] == [1]
    assert [r["id"] for r in search.fts(index, ["text", "search"], "phrase").collect()] == [4]
    assert search.fts(index, ["search", "text"], "phrase").count() == 0
    assert [r["id"] for r in search.fts(index, ["granite", "pasta"], "or", 1).collect()] == [2]


def test_bigrams(spark):
    index = search.build_bigrams(values_table(spark, DOCS, "id long, body string"), "id", "body")
    assert [r["id"] for r in search.bigram_candidates(index, "text").collect()] == [4]
    assert search.bigram_candidates(index, "#").count() == 0
    sim = one(spark, similarity.bigram_sim(F.lit("Spreadsheet"), F.lit("Spreadshee")))[0]
    assert 0.5 < sim < 1


def test_string_similarity(spark):
    got = one(spark, similarity.edit_sim(F.lit("hello"), F.lit("hallo")), similarity.token_cosine(F.lit("hello world"), F.lit("hello world")),
              similarity.token_jaccard(F.lit("a b c"), F.lit("b c d")), similarity.jaro(F.lit("martha"), F.lit("marhta")),
              similarity.jaro_winkler(F.lit("martha"), F.lit("marhta")))
    assert got[0] == 0.8 and got[1] > 0.99 and got[2] == 0.5
    assert got[3] == pytest.approx(0.944444, abs=1e-6) and got[4] == pytest.approx(0.961111, abs=1e-6)


def test_token_sim_of_tables(spark):
    pairs = values_table(spark, [(1, "hello world", "hello world"), (2, "a b c", "b c d"), (3, "", "-")], "id int, a string, b string")
    got = {r["id"]: (round(r["cosine"], 6), r["jaccard"]) for r in similarity.token_sim(pairs, "id", "a", "b").collect()}
    assert got == {1: (1.0, 1.0), 2: (0.666667, 0.5), 3: (0.0, 0.0)}


@pytest.mark.parametrize("kind,minimum", [("bigram", 0.6), ("jaccard", 0.5), ("edit", 0.55)])
def test_fuzzy_join_against_brute_force(spark, kind, minimum):
    words = ["red ring", "red rings", "ring red", "blue ring small", "small blue ring", "a", "ab", "abc", "abd", "xyz", "red ring"]
    left, right = (values_table(spark, [(w,) for w in words], f"{c} string") for c in "ab")
    score = {"bigram": similarity.bigram_sim, "jaccard": similarity.token_jaccard, "edit": similarity.edit_sim}[kind]
    every = left.distinct().crossJoin(right.distinct()).where(score(F.col("a"), F.col("b")) >= minimum - 1e-12)
    want = sorted((r["a"], r["b"]) for r in every.collect())
    got = sorted((r["a"], r["b"]) for r in similarity.fuzzy_join(left, right, "a", "b", kind, minimum).collect())
    assert got == want


# --- vectors, geography, graph -----------------------------------------------

def test_vectors(spark):
    rows = values_table(spark, [(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0]), (3, [7.0, 8.0, 9.0])], "id long, v array<float>")
    asked = values_table(spark, [(0, [1.0, 2.0, 3.0])], "q long, v array<float>")
    assert vectors.knn(rows, "id", "v", asked, "q", "v", 1).first()["id"] == 1
    x, y = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert one(spark, vectors.cosine_dist(x, y))[0] > 0.9
    index = vectors.build_ann(rows, "id", "v", 2)
    assert vectors.ann_search(index, asked, "q", "v", 3, probes=2).count() == 3


def test_geography(spark):
    row = one(spark, geo.geo_distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
              geo.central_angle(F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2), F.lit(0.0)),
              geo.to_geojson(F.lit(1.5), F.lit(2.0)), geo.read_wkt_point(F.lit("POINT(1.5 2)")),
              geo.hex_resolution(geo.hex_cell(F.lit(2.3522), F.lit(48.8566), 7)))
    assert 110000 < row[0] < 112000 and abs(row[1] - math.pi / 2) < 1e-9
    assert row[2] == '{"type":"Point","coordinates":[1.5,2.0]}' and tuple(row[3]) == (1.5, 2.0) and row[4] == 7


def test_polygons_against_brute_force(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]
    shape = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
    box = geo.envelope(F.lit(-3.0), F.lit(-3.0), F.lit(500.0), F.lit(500.0))
    polygons = spark.range(1).select(F.lit(1).alias("pid"), shape.alias("ring")).unionByName(
        spark.range(1).select(F.lit(2).alias("pid"), box.alias("ring")))
    points = values_table(spark, [(5.0, 5.0), (5.0, 2.0), (0.0, 5.0), (1.0, 7.0), (9.0, 8.0), (20.0, 20.0), (-3.0, 0.0)], "x double, y double")
    got = sorted((r["pid"], r["x"], r["y"]) for r in geo.contains_join(points, polygons, "x", "y").collect())
    assert got == sorted([(1, 5.0, 2.0), (1, 1.0, 7.0), (1, 9.0, 8.0)]
                         + [(2, *p) for p in [(5.0, 5.0), (5.0, 2.0), (0.0, 5.0), (1.0, 7.0), (9.0, 8.0), (20.0, 20.0)]])


def test_hex_cells_hold_their_centres(spark):
    cells = spark.range(200).select(geo.hex_cell(F.col("id") * 1.7 - 170, F.col("id") * 0.8 - 80, 4).alias("c"))
    centres = cells.withColumn("at", geo.hex_centre(F.col("c")))
    again = geo.with_hex_cell(centres, F.col("at.lon"), F.col("at.lat"), 4, "again").select("c", "again").collect()
    assert len(again) == 200 and all(r["c"] == r["again"] for r in again)
    counted = geo.hex_bins(spark.range(200).select((F.col("id") * 1.7 - 170).alias("lon"), (F.col("id") * 0.8 - 80).alias("lat")), "lon", "lat", 4)
    assert geo.hex_rollup(counted, 2).agg(F.sum("points")).first()[0] == 200


def test_shortest_path(spark):
    legs = [("quay", "lock", 4.0), ("lock", "mill", 1.5), ("quay", "ford", 2.5), ("ford", "lock", 1.0), ("mill", "weir", 2.0), ("ford", "weir", 9.0)]
    edges = values_table(spark, legs, "source string, target string, cost double")
    route = [(r["node"], r["agg_cost"]) for r in graph.dijkstra(edges, "quay", "weir").orderBy("seq").collect()]
    assert route == [("quay", 0.0), ("ford", 2.5), ("lock", 3.5), ("mill", 5.0), ("weir", 7.0)]
    assert graph.dijkstra(edges, "weir", "quay").count() == 0


def test_graph(spark):
    ports = values_table(spark, [("Bergen", 12), ("Gdansk", 31), ("Porto", 8)], "city string, cranes int")
    v = graph.create_vertices(ports, "Port", ["city"], ["city", "cranes"])
    e = graph.create_edges(spark.range(1), "SHIPS_TO", graph.vertex_id("Port", F.lit("Porto")), graph.vertex_id("Port", F.lit("Gdansk")))
    ships = [{"label": "Port"}, {"type": "SHIPS_TO"}, {"label": "Port", "where": [("$.cranes", ">", 20)]}]
    assert [(r["n0"], r["n1"]) for r in graph.match(v, e, ships).collect()] == [("Port:Porto", "Port:Gdansk")]
    back = [{"label": "Port"}, {"type": "SHIPS_TO", "direction": "in"}, {"label": "Port"}]
    assert graph.match(v, e, back).first()["n0"] == "Port:Gdansk"
    path = scratch_path(spark, "graph-test")
    graph.save_graph(v, e, path)
    assert graph.load_graph(spark, path)[0].count() == 3
    assert graph.drop_graph(spark, path)


# --- privacy, checks, functions ----------------------------------------------

def test_privacy(spark):
    df = values_table(spark, [("Ann", "4111222233334444"), ("Ann", None)], "n string, card string")
    out = mask(df, {"n": ("fake", ["X", "Y", "Z"]), "card": ("partial", 0, 4)}, "k").collect()
    assert out[0]["n"] == out[1]["n"] and out[0]["card"] == "*" * 12 + "4444" and out[1]["card"] is None
    sealed = encrypt(df, ["card"], "k")
    assert decrypt(sealed, {"card": "string"}, "k").first()["card"] == "4111222233334444"
    assert decrypt(sealed, {"card": "string"}, "other").first()["card"] is None
    swapped = sealed.select("n", F.col("card").alias("n2"))
    assert decrypt(swapped, {"n2": "string"}, "k").first()["n2"] is None


def test_secrets_stay_out_of_plans(spark):
    table = spark.range(3).select(F.col("id").cast("string").alias("c"))
    key = hashlib.sha256(b"secret:hush-hush").hexdigest()
    for df in (encrypt(table, ["c"], "hush-hush"), mask(table, {"c": ("hash",)}, "hush-hush")):
        df.collect()
        run = df._jdf.queryExecution()
        shown = run.toString() + run.executedPlan().toString() + run.optimizedPlan().toString()
        assert "ubquery" in shown and "hush" not in shown and key not in shown.lower()
    assert "hush" not in shown and not re.search("0x[0-9a-fA-F]{32}", shown)


def test_checks(spark):
    lines = [r["line"] for r in run_checks([check_value(spark, "one equals one", 1, 1), check_value(spark, "zzz differs", 1, 1, equal=False)])
             .orderBy("number").collect()]
    assert lines == ["ok 1 - one equals one", "not ok 2 - zzz differs"]


def test_user_function_in_sql(spark):
    register_scalar(spark, "add_two", lambda a, b: a + b, "int")
    register_scalar(spark, "array_total", lambda xs: sum(xs), "int")
    assert tuple(spark.sql("SELECT add_two(2, 3), array_total(array(1, 2, 3, 4, 5))").first()) == (5, 15)


# --- streaming ---------------------------------------------------------------

def test_incremental_view(spark):
    source, view, state = (scratch_path(spark, n) for n in ("meters", "view", "state"))

    def add(rows):
        values_table(spark, rows, "meter string, kwh int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("meter string, kwh int").parquet(source)
        run_to_end(incremental_view(stream, ["meter"], [F.sum("kwh").alias("total"), F.max("kwh").alias("peak")]), view, checkpoint=state)
        return {r["meter"]: (r["total"], r["peak"]) for r in read_view(spark, view, ["meter"]).collect()}

    assert add([("north", 7), ("south", 3), ("north", 11)]) == {"north": (18, 11), "south": (3, 3)}
    assert add([("south", 20), ("west", 1)]) == {"north": (18, 11), "south": (23, 20), "west": (1, 1)}
    small = compact_view(spark, view, scratch_path(spark, "view-compact"), ["meter"])
    assert {r["meter"]: r["total"] for r in small.collect()} == {"north": 18, "south": 23, "west": 1}


def test_refresh_groups(spark):
    base = values_table(spark, [("A", 1), ("A", 7), ("B", 4)], "p string, x int")
    aggs = [F.min("x").alias("lo"), F.max("x").alias("hi")]
    view = incremental_view(base, ["p"], aggs)
    rest = base.where("NOT (p = 'A' AND x = 7)")
    got = refresh_groups(view, rest, values_table(spark, [("A",)], "p string"), ["p"], aggs)
    assert sorted(map(tuple, got.collect())) == [("A", 1, 1), ("B", 4, 4)]


def test_late_rows_are_dropped_and_counted(spark):
    source, out = scratch_path(spark, "late"), scratch_path(spark, "late-out")

    def at(hour):
        return dt.datetime(2024, 1, 1, hour, 30)

    # rows are late against the watermark the previous batch ran with, so one batch lies between
    for hours in ([1, 2], [20], [20], [1], [21]):
        values_table(spark, [(at(h),) for h in hours], "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(source)
    dropped = run_to_end(time_bucket_agg(stream, "ts", "1 hour", [], [F.count(F.lit(1)).alias("n")], watermark="1 hour"), out, mode="append")
    got = {r["bucket"].hour: r["n"] for r in read_view(spark, out, ["bucket"]).collect()}
    assert got == {1: 1, 2: 1} and dropped == 1


def test_signed_view(spark):
    rows = values_table(spark, [("A", 100, 1), ("A", 50, 1), ("A", 100, -1)], "p string, amount int, sign int")
    assert tuple(signed_view(rows, ["p"], "sign", {"total": "amount"}).first()) == ("A", 1, 50)


def test_queue(spark):
    now = dt.datetime(2024, 1, 1, 12)
    ops = spark.createDataFrame([], OPS)
    messages = values_table(spark, [("q", '{"meter":"north"}', now)], "queue string, m string, at timestamp_ntz")
    ops = send(ops, messages, "queue", "m", "at", [F.asc("m")])
    taken, ops = read(ops, "q", now, 1)
    assert [(r["msg_id"], r["message"]) for r in taken.collect()] == [(1, '{"meter":"north"}')]
    assert read(ops, "q", now + dt.timedelta(seconds=10), 1)[0].count() == 0
    assert read(ops, "q", now + dt.timedelta(seconds=30), 1)[0].count() == 1
    ops = archive(ops, taken, now)
    places = {r["place"]: r["count"] for r in queue_state(ops).groupBy("place").count().collect()}
    assert places == {"archive": 1}
    assert send(ops, messages, "queue", "m", "at", [F.asc("m")]).agg(F.max("msg_id")).first()[0] == 2
    assert drop_queue(ops, "q").count() == 0


def test_expired_reads(spark):
    source, out = scratch_path(spark, "ops"), scratch_path(spark, "expired")

    def at(second):
        return dt.datetime(2024, 1, 1, 0, 0, second)

    batches = [[("q", 1, "read", at(0), None), ("q", 2, "read", at(0), None)], [("q", 2, "archive", at(5), None)],
               [("q", 9, "send", at(50), "x")], [("q", 9, "send", at(51), "x")]]
    for rows in batches:
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(source)
    run_to_end(expired_reads(stream, 30), out, mode="append")
    rows = spark.read.parquet(out).collect()
    assert [(r["queue"], r["msg_id"], r["visible_again"]) for r in rows] == [("q", 1, at(30))]


@pytest.mark.parametrize("width", [0.5, 3.0, 1000.0])
def test_routes_of_brute_force(spark, width):
    """Buckets narrower and wider than an edge, edges of no cost, ties, unreachable targets, a long chain."""
    import heapq
    import random

    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60), float(r.choice([0, 0, 1, 1, 2, 5, 9]))) for _ in range(150)]
    edges += [(100 + i, 101 + i, 1.0) for i in range(40)] + [(5, 100, 0.0)]
    lanes = {}
    for a, b, c in edges:
        lanes.setdefault(a, {})
        lanes[a][b] = min(c, lanes[a].get(b, c))

    def trees(origin):
        best, heap = {}, [(0.0, 0, -1, origin)]
        while heap:
            cost, hops, prev, node = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = (cost, hops, None if prev < 0 else prev)
            for to, c in lanes.get(node, {}).items():
                heapq.heappush(heap, (cost + c, hops + 1, node, to))
        return best

    df = spark.createDataFrame(edges, "source long, target long, cost double")
    origins = spark.createDataFrame([(0,), (5,), (999,), (None,)], "origin long")
    got = {(x.origin, x.node): (x.cost, x.hops, x.prev) for x in graph.shortest_path_trees(df, origins, width).collect()}
    want = {(o, n): b for o in (0, 5, 999) for n, b in trees(o).items()}
    assert got == want
    if width == 3.0:
        pairs = [(5, 140), (0, 0), (0, 17), (140, 5), (5, 100)]
        rows = {}
        for x in graph.routes(df, spark.createDataFrame(pairs, "a long, b long")).collect():
            rows.setdefault((x.origin, x.target), []).append((x.seq, x.node, x.agg_cost))
        for o, target in pairs:
            best, path, node = trees(o), [], target
            while node is not None and target in best:
                path.append((best[node][1] + 1, node, best[node][0]))
                node = best[node][2]
            assert sorted(rows.get((o, target), [])) == path[::-1]


def test_tdigest(spark):
    """Merged from many parts: ranks close everywhere and closest at the ends, least and greatest exact."""
    import numpy as np

    r = np.random.default_rng(5)
    numbers = {"a": r.lognormal(0, 2, 20000), "b": np.arange(1, 1001.0), "c": np.array([7.0]), "d": np.repeat([1.0, 2.0], 500)}
    rows = [(k, i % 7, float(x)) for k, xs in numbers.items() for i, x in enumerate(xs)] + [("a", 0, None), ("e", 0, None), (None, 0, 3.0)]
    df = spark.createDataFrame(rows, "k string, part int, x double").repartition(6)
    probs = [0.0, 0.001, 0.01, 0.5, 0.99, 0.999, 1.0]
    merged = sketches.tdigest_rollup(sketches.tdigest_build(df, ["k", "part"], "x"), ["k"])
    assert {d.k: len(d.means) <= sketches.DELTA + 2 for d in merged.collect()} == {k: True for k in ("a", "b", "c", "d", None)}
    got = {(x.k, x.p): x.quantile for x in sketches.tdigest_read(merged, probs).collect()}
    for k, xs in numbers.items():
        xs = np.sort(xs)
        assert (got[k, 0.0], got[k, 1.0]) == (xs[0], xs[-1])
        for p in probs:
            rank = (np.searchsorted(xs, got[k, p], "left") / len(xs), np.searchsorted(xs, got[k, p], "right") / len(xs))
            slack = 0.03 * (p * (1 - p)) ** 0.5 + 1.5 / len(xs)
            assert rank[0] - slack <= p <= rank[1] + slack, (k, p)
    assert abs(got["b", 0.5] - 500) < 20 and got["b", 0.99] > 980 and got[None, 0.5] == 3.0
    ranks = {(x.k, x.value): x["rank"] for x in sketches.tdigest_read(merged, [], [250.0, 2000.0]).collect()}
    assert abs(ranks["b", 250.0] - 0.25) < 0.01 and ranks["b", 2000.0] == 1.0


def test_ipv6_ranges_of_brute_force(spark):
    import ipaddress
    import random

    r = random.Random(3)
    near = [r.getrandbits(128) for _ in range(6)] + [0, (1 << 128) - 1, 1 << 64, (1 << 64) - 1, 1 << 96, (1 << 32) - 1]
    some = lambda: max(0, min((1 << 128) - 1, r.choice(near) + r.choice([-1, 1]) * r.getrandbits(r.choice([1, 8, 31, 33, 63, 65, 97, 120]))))
    points = [some() for _ in range(150)] + near
    spans = [tuple(sorted((some(), some()))) for _ in range(60)] + [(n, n) for n in near] + [(5, 2), (0, (1 << 128) - 1)]
    text = lambda n: r.choice([str, lambda a: a.exploded.upper()])(ipaddress.IPv6Address(n))
    a = values_table(spark, [(i, text(p)) for i, p in enumerate(points)] + [(900, None), (901, "no"), (902, "1:2:3"), (903, "::1::2"), (904, "12345::")], "i int, ip string")
    b = values_table(spark, [(j, text(x), text(y)) for j, (x, y) in enumerate(spans)] + [(900, None, "::1"), (901, "x", "y")], "j int, x string, y string")
    got = sorted((x.i, x.j) for x in ranges.ipv6_range_join(a, b, "ip", "x", "y").select("i", "j").collect())
    assert got == sorted((i, j) for i, p in enumerate(points) for j, (x, y) in enumerate(spans) if x <= p <= y)
    nets = [ipaddress.IPv6Network((some(), n), strict=False) for n in (0, 1, 31, 32, 33, 63, 64, 65, 96, 127, 128) for _ in range(4)]
    c = values_table(spark, [(j, str(n)) for j, n in enumerate(nets)] + [(900, "::/129"), (901, "::/x"), (902, None), (903, "::ffff:1.2.3.4")], "j int, net string")
    got = sorted((x.i, x.j) for x in ranges.ipv6_join(a, c, "ip", "net").select("i", "j").collect())
    assert got == sorted((i, j) for i, p in enumerate(points) for j, n in enumerate(nets) if ipaddress.IPv6Address(p) in n)
    assert ranges.ipv6_join(values_table(spark, [(1, "::FFFF:102:304")], "i int, ip string"), c, "ip", "net").where("j = 903").count() == 1

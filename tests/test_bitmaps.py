"""Adaptive bitmaps against Python sets, reach against breadth-first search."""

import random

import numpy as np
import pytest

from lodework.operators import bitmaps, graph
from lodework.operators.bitmaps import ARRAY, BITS, RUNS, pack, unpack


@pytest.mark.parametrize("numbers, kind", [
    ([0], ARRAY), ([65535], ARRAY), ([0, 65535], ARRAY), (range(0, 8000, 2), ARRAY), (range(0, 40_000, 3), BITS), (range(65536), RUNS),
    ([5, 6, 7, 8], RUNS), (list(range(100, 9000)) + [60_000], RUNS)])
def test_containers(numbers, kind):
    numbers = np.array(list(numbers))
    found, data = pack(numbers)
    assert found == kind and len(data) <= min(2 * len(numbers), 8192) and np.array_equal(unpack(found, data), numbers)


def sets():
    r = random.Random(3)
    spread = lambda n: {r.randint(-(1 << 62), 1 << 62) for _ in range(n)}
    common = spread(200)
    a = common | spread(300) | set(range(-70_000, 90_000)) | {r.randint(1 << 40, (1 << 40) + 200_000) for _ in range(60_000)} | {-1, (1 << 63) - 1, -(1 << 63)}
    b = common | spread(300) | set(range(50_000, 150_000, 2)) | {r.randint(1 << 40, (1 << 40) + 200_000) for _ in range(50_000)} | {-1, 0}
    return a, b


def table(spark, groups):
    rows = [(k, x) for k, s in groups.items() for x in s] + [(k, None) for k in groups]
    return spark.createDataFrame(rows + rows[:1000], "k string, x long")


def members(df, keys=("k",)):
    out = {}
    for row in bitmaps.bitmap_members(df, list(keys)).collect():
        out.setdefault(tuple(row[k] for k in keys), []).append(row["member"])
    assert all(len(v) == len(set(v)) for v in out.values())
    return {k: set(v) for k, v in out.items()}


def test_sets(spark):
    a, b = sets()
    one = bitmaps.bitmap_build(table(spark, {"a": a, None: {1, 2}, "only": {9}}), ["k"], "x").persist()
    two = bitmaps.bitmap_build(table(spark, {"a": b, None: {2, 3}, "other": {9}}), ["k"], "x").persist()
    assert members(one) == {("a",): a, (None,): {1, 2}, ("only",): {9}}
    assert {r.k: r.cardinality for r in bitmaps.bitmap_cardinality(one, ["k"]).collect()} == {"a": len(a), None: 2, "only": 1}
    assert {r.kind for r in one.collect()} == {ARRAY, BITS, RUNS}
    wanted = {"and": a & b, "or": a | b, "xor": a ^ b, "andnot": a - b}
    few = {"and": {2}, "or": {1, 2, 3}, "xor": {1, 3}, "andnot": {1}}
    alone = {"and": {}, "or": {("only",): {9}, ("other",): {9}}, "xor": {("only",): {9}, ("other",): {9}}, "andnot": {("only",): {9}}}
    for op in wanted:
        found = bitmaps.bitmap_combine(one, two, ["k"], op)
        assert members(found) == {("a",): wanted[op], (None,): few[op]} | alone[op]
        assert {r.k: r.cardinality for r in bitmaps.bitmap_cardinality(found, ["k"]).collect()}["a"] == len(wanted[op])
    with pytest.raises(ValueError, match="op is one of"):
        bitmaps.bitmap_combine(one, two, ["k"], "nand")
    whole = bitmaps.bitmap_rollup(one.unionByName(two), [])
    assert members(whole, ()) == {(): a | b | {1, 2, 3, 9}}
    asked = spark.createDataFrame([("a", x) for x in list(a)[:300] + list(b)[:300] + [None, 91_000]] + [(None, 2), (None, 5), ("no", 1)], "k string, y long")
    got = bitmaps.bitmap_contains(one, asked, ["k"], "y").collect()
    assert sorted((r.k or "", r.y) for r in got) == sorted([("a", x) for x in list(a)[:300] + [x for x in list(b)[:300] if x in a] + [91_000] * (91_000 in a)] + [("", 2)])
    assert bitmaps.bitmap_build(table(spark, {}), ["k"], "x").count() == 0


def test_sparse_sets_are_small(spark):
    found = bitmaps.bitmap_build(spark.range(1000).selectExpr("1 AS k", "id * 65536 * 7 AS x"), ["k"], "x")
    assert found.selectExpr("sum(length(data))").first()[0] == 2000
    dense = bitmaps.bitmap_build(spark.range(1 << 20).selectExpr("1 AS k", "id AS x"), ["k"], "x")
    assert dense.selectExpr("sum(length(data))", "count(*)").first()[:] == (64, 16)


def test_reach_of_many_origins(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(260)] + [(0, x) for x in range(60)] + [(None, 1), (1, None)]
    origins = [*range(0, 121), 500, None, 7]
    near = {}
    for s, d in edges:
        near.setdefault(s, set()).add(d)
    wanted = set()
    for o in {x for x in origins if x is not None}:
        seen, front = {o: 0}, [o]
        for hop in range(1, 4):
            front = [d for d in {d for n in front for d in near.get(n, ()) if d is not None} if d not in seen]
            seen |= dict.fromkeys(front, hop)
        wanted |= {(o, n, h) for n, h in seen.items()}
    got = graph.reach(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(x,) for x in origins], "id long"), 3)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted

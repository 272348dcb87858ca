"""Extremes kept through deletes, against recomputation."""

import random
from collections import Counter
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodework.session import scratch_path
from lodework.streaming.extremes import Ends, ValueCounts, extremes_view, read_extremes
from lodework.streaming.views import run_to_end


def test_ends():
    r = random.Random(1)
    values, ends = set(), Ends([], [], 0, 3)
    for _ in range(3000):
        if values and r.random() < 0.52:
            x = r.choice([min(values), max(values), r.choice(sorted(values))])
            values.remove(x)
            ends.remove(x)
            if ends.spent():
                ends.lows, ends.highs = sorted(values)[:3], sorted(values)[-3:]
        else:
            x = r.choice([y for y in range(60) if y not in values])
            values.add(x)
            ends.add(x)
        assert ends.distinct == len(values)
        if values:
            assert ends.lows[0] == min(values) and ends.highs[-1] == max(values)
            assert ends.lows == sorted(values)[: len(ends.lows)] and ends.highs == sorted(values)[-len(ends.highs) :]


def test_view(spark):
    r = random.Random(2)
    live, rows = [], []
    for batch in range(4):
        for _ in range(150):
            if live and r.random() < 0.45:
                key = r.choice(["a", None])
                own = [x for x in live if x[0] == key and x[1] is not None]
                if own:
                    gone = (max if r.random() < 0.5 else min)(own, key=lambda x: x[1])
                    live.remove(gone)
                    rows.append((batch, *gone, -1))
                    continue
            new = (r.choice(["a", "a", None, "gone"]), r.choice([None, r.randint(-50, 50), (1 << 60) + r.randint(0, 3)]))
            if new[0] == "gone":
                rows += [(batch, *new, -1), (batch, *new, 1)]
            else:
                live.append(new)
                rows.append((batch, *new, 1))
    source = scratch_path(spark, "extremes-test")
    table = spark.createDataFrame(rows, "batch int, k string, x long, sign int")
    for batch in range(4):
        table.where(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k string, x long, sign int").option("maxFilesPerTrigger", 1).parquet(source)
    path = scratch_path(spark, "extremes-view")
    run_to_end(extremes_view(stream, ["k"], "x", "sign", shards=2, width=2), path, partitions=2)
    got = {r.k: (r.row_count, r.low, r.high) for r in read_extremes(spark, path, ["k"]).collect()}
    wanted = {}
    for k in {k for k, _ in live}:
        xs = [x for g, x in live if g == k and x is not None]
        wanted[k] = (sum(g == k for g, _ in live), min(xs, default=None), max(xs, default=None))
    assert got == wanted


def test_expiry(spark):
    source = scratch_path(spark, "expiry-test")
    for batch in [[("old", 1.0, "2024-01-01 00:00:00", 1), ("kept", 2.0, "2024-01-01 00:00:00", 1)], [("kept", 3.0, "2024-01-01 09:00:00", 1)],
                  [("kept", 4.0, "2024-01-01 10:00:00", 1)], [("kept", 1.5, "2024-01-01 11:00:00", 1)]]:
        spark.createDataFrame(batch, "k string, x double, at string, sign int").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k string, x double, at timestamp, sign int").option("maxFilesPerTrigger", 1).parquet(source).withWatermark("at", "1 minute")
    path = scratch_path(spark, "expiry-view")
    run_to_end(extremes_view(stream, ["k"], "x", "sign", shards=1, event_time="at", keep_ms=3_600_000 * 12), path, partitions=2)
    assert {r.k: (r.row_count, r.low, r.high) for r in read_extremes(spark, path, ["k"]).collect()} == {"old": (1, 1.0, 1.0), "kept": (4, 1.5, 4.0)}
    path = scratch_path(spark, "expiry-view")
    run_to_end(extremes_view(stream, ["k"], "x", "sign", shards=1, event_time="at", keep_ms=3_600_000 * 5), path, partitions=2)
    assert "old" not in {r.k for r in read_extremes(spark, path, ["k"]).collect()}


class Kept:
    """A map and a value as the state of one group, with the number of calls."""

    def __init__(self):
        self.map, self.one, self.calls = {}, None, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]

    def exists(self):
        return self.one is not None

    def get(self):
        return self.one

    def update(self, value):
        self.one = value


def changes(values, signs):
    return pd.DataFrame({"value_": values, "sign_": signs, "has_": [v is not None for v in values], "at_": 0})


@pytest.mark.parametrize("value", [int, str, float, Decimal])
def test_runs(value):
    """Small parts, deletes before inserts, an emptied end: the ends are those of a recount."""
    r = random.Random(5)
    state, held, out = Kept(), Counter(), None
    counts = ValueCounts(["k"], "any", 3, None, part=7)
    counts.init(state)
    for batch in range(60):
        rows = [(r.randrange(-500, 500), r.choice([1, 1, -1])) for _ in range(r.randrange(1, 60))]
        live = sorted(v for v, n in held.items() if n > 0)
        rows += [(v, -held[v]) for v in (live[:8] if batch % 3 else live[-8:])]
        for v, n in rows:
            held[v] += n
        out = next(counts.handleInputRows(("a",), iter([changes([value(v) for v, _ in rows], [n for _, n in rows])]), None))
        live = sorted(value(v) for v, n in held.items() if n > 0)
        assert out[["low", "high"]].values.tolist() == [[live[0], live[-1]] if live else [None, None]]
        assert out.row_count.tolist() == [sum(held.values())]
    assert sum(state.one[4]) <= 2 * len(held) and len(state.map) == sum(state.one[3])


def test_state_calls():
    """State is called for many values at once: before, two or three times for each."""
    r = random.Random(6)
    state = Kept()
    counts = ValueCounts(["k"], "double", 32, None)
    counts.init(state)
    for _ in range(16):
        list(counts.handleInputRows(("a",), iter([changes([r.random() for _ in range(10_000)], [1] * 10_000)]), None))
    assert state.calls < 160_000 / 100

"""Least and greatest values of groups, kept current through deletes.

The keyed state of a group holds changes of counts by value as sorted runs: a micro-batch adds one, and runs are merged
while the one before is not more than twice as large, so a change is rewritten a logarithmic number of times and state is
called once for ``PART`` of them.  The ends, the ``WIDTH`` least and greatest values there, are read from the ends of the
runs, and only if a batch changed a value at one of them.  Groups are split into shards by a hash of the value, so a group
with a third of all rows is no single task's; reading the view puts the shards together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodework.streaming.views import read_view

WIDTH, SHARDS = 32, 8
#: Values of one entry of the state.
PART = 4096


class Ends:
    """The least and greatest of a set of values, ``width`` of each at most."""

    def __init__(self, lows: list, highs: list, distinct: int, width: int):
        self.lows, self.highs, self.distinct, self.width = lows, highs, distinct, width

    def add(self, value) -> None:
        if len(self.lows) == self.distinct or value < self.lows[-1]:
            insort(self.lows, value)
            del self.lows[self.width :]
        if len(self.highs) == self.distinct or value > self.highs[0]:
            insort(self.highs, value)
            del self.highs[: -self.width]
        self.distinct += 1

    def remove(self, value) -> None:
        for side in (self.lows, self.highs):
            at = bisect_left(side, value)
            if at < len(side) and side[at] == value:
                del side[at]
        self.distinct -= 1

    def spent(self) -> bool:
        return self.distinct > 0 and not (self.lows and self.highs)


def merged(runs: list[Iterator[pd.Series]], falling: bool = False) -> Iterator[pd.Series]:
    """Sums of changes by value over sorted runs, in the same order, a stretch at a time; values without change go.

    A run is its parts in order, of which one is held at a time.
    """
    held = [(part, rest) for rest in runs if (part := next(rest, None)) is not None]
    while held:
        # no later part has values up to here
        border = (max if falling else min)(part.index[-1] for part, _ in held)
        taken, left = [], []
        for part, rest in held:
            # sorted, so what lies within the border comes first
            n = len(part) - part.index[::-1].searchsorted(border) if falling else part.index.searchsorted(border, side="right")
            taken.append(part.iloc[:n])
            part = part.iloc[n:] if n < len(part) else next(rest, None)
            if part is not None:
                left.append((part, rest))
        held = left
        sums = pd.concat(taken).groupby(level=0, sort=True).sum()
        sums = sums[sums != 0]
        if len(sums):
            yield sums[::-1] if falling else sums


class ValueCounts(StatefulProcessor):
    """State of one shard of a group: changes by value in sorted runs, the ends, the rows and the latest event."""

    def __init__(self, keys: list[str], kind: str, width: int, keep_ms: int | None, part: int = PART):
        self.keys, self.kind, self.width, self.keep_ms, self.part = keys, kind, width, keep_ms, part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getMapState("changes", "run bigint, part int", f"vals array<{self.kind}>, counts array<bigint>")
        self.ends = handle.getValueState("ends", f"lows array<{self.kind}>, highs array<{self.kind}>, runs array<bigint>, parts array<int>, "
                                                 "sizes array<bigint>, rows bigint, latest bigint")

    def row(self, key, rows: int, ends: Ends) -> pd.DataFrame:
        low, high = (ends.lows[0], ends.highs[-1]) if ends.distinct else (None, None)
        return pd.DataFrame([(*key, rows, low, high)], columns=[*self.keys, "row_count", "low", "high"]).astype({"low": object, "high": object})

    def read(self, run: tuple[int, int, int], falling: bool = False) -> Iterator[pd.Series]:
        """The parts of a run (its number, parts and size)."""
        for part in reversed(range(run[1])) if falling else range(run[1]):
            values, counts = self.changes.getValue((run[0], part))
            sums = pd.Series(list(counts), index=pd.Index(list(values)), dtype="int64")
            yield sums[::-1] if falling else sums

    def write(self, number: int, stretches: Iterator[pd.Series]) -> tuple[int, int, int]:
        """A new run of sorted stretches."""
        parts = size = 0
        held = None
        for stretch in stretches:
            held = stretch if held is None else pd.concat([held, stretch])
            full = len(held) // self.part * self.part
            for at in range(0, full, self.part):
                self.put(number, parts, held.iloc[at : at + self.part])
                parts += 1
            size, held = size + len(stretch), held.iloc[full:]
        if held is not None and len(held):
            self.put(number, parts, held)
            parts += 1
        return number, parts, size

    def put(self, number: int, part: int, sums: pd.Series) -> None:
        self.changes.updateValue((number, part), (sums.index.tolist(), sums.tolist()))

    def add(self, runs: list[tuple[int, int, int]], sums: pd.Series) -> None:
        """The changes as one more run; the last ones become one while the one before is not more than twice as large."""
        number = count(max((n for n, _, _ in runs), default=-1) + 1)
        runs.append(self.write(next(number), iter([sums])))
        while len(runs) > 1 and runs[-2][2] <= 2 * runs[-1][2]:
            old = [runs.pop(), runs.pop()]
            new = self.write(next(number), merged([self.read(run) for run in old]))
            for run, parts, _ in old:
                for part in range(parts):
                    self.changes.removeKey((run, part))
            if new[2]:
                runs.append(new)

    def live(self, runs: list[tuple[int, int, int]], falling: bool = False) -> list:
        """The first values that are there, ``width`` at most, from the least or from the greatest on."""
        out: list = []
        for sums in merged([self.read(run, falling) for run in runs], falling):
            # a delete may come before its insert: the count is below zero until then
            out += sums.index[sums > 0][: self.width - len(out)].tolist()
            if len(out) == self.width:
                break
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lows, highs, numbers, parts, sizes, total, latest = self.ends.get() if self.ends.exists() else ([], [], [], [], [], 0, -1)
        lows, highs, runs = list(lows), list(highs), list(zip(numbers, parts, sizes))
        touched_low, touched_high = len(lows) < self.width, len(highs) < self.width
        for frame in rows:
            total += int(frame["sign_"].sum())
            latest = max(latest, int(frame["at_"].max()))
            sums = frame[frame["has_"]].groupby("value_")["sign_"].sum()
            sums = sums[sums != 0]
            if len(sums):
                touched_low = touched_low or bool(sums.index[0] <= lows[-1])
                touched_high = touched_high or bool(sums.index[-1] >= highs[0])
                self.add(runs, sums)
        if touched_low:
            lows = self.live(runs)
        if touched_high:
            highs = self.live(runs, True)[::-1]
        self.ends.update((lows, highs, *([run[k] for run in runs] for k in range(3)), total, latest))
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(int(timer[0] if isinstance(timer, (tuple, list)) else timer))
            self.handle.registerTimer(latest + self.keep_ms)
        yield self.row(key, total, Ends(lows, highs, len(lows), self.width))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No event for ``keep_ms``: the group leaves state and view."""
        self.changes.clear()
        self.ends.clear()
        yield self.row(key, 0, Ends([], [], 0, self.width))

    def close(self) -> None:
        pass


def extremes_view(stream: DataFrame, keys: list[str], column: str, sign: str, shards: int = SHARDS, width: int = WIDTH,
                  event_time: str | None = None, keep_ms: int | None = None) -> DataFrame:
    """(keys, shard_, row_count, low, high) over inserts (+1) and deletes (-1) in the column ``sign``.

    NULLs count as rows only.  A delete may arrive before its insert.  With ``event_time`` (a watermarked timestamp) and
    ``keep_ms``, groups without an event for so long leave the state.
    """
    kind = stream.schema[column].dataType.simpleString()
    value = F.col(column)
    at = F.unix_millis(F.col(event_time).cast("timestamp")) if event_time else F.lit(0).cast("long")
    rows = stream.select(*keys, F.pmod(F.xxhash64(value), F.lit(shards)).cast("int").alias("shard_"), value.isNotNull().alias("has_"),
                         F.coalesce(value, F.lit("0").cast(kind)).alias("value_"), F.col(sign).cast("long").alias("sign_"), at.alias("at_"),
                         *([F.col(event_time).alias("event_")] if event_time else []))
    names = [*keys, "shard_"]
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names] + ["row_count bigint", f"low {kind}", f"high {kind}"])
    return rows.groupBy(*names).transformWithStateInPandas(ValueCounts(names, kind, width, keep_ms), schema, "Update",
                                                           "eventTime" if keep_ms is not None else "None")


def read_extremes(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, row_count, low, high) of the groups that have rows."""
    shards = read_view(spark, path, [*keys, "shard_"])
    return shards.groupBy(*keys).agg(F.sum("row_count").alias("row_count"), F.min("low").alias("low"), F.max("high").alias("high")).where("row_count > 0")

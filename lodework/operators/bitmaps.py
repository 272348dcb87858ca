"""Sets of 64-bit integers in adaptive containers.

A set is rows (keys, high, kind, n, data): one container for the members that share all but their low 16 bits.  A
container is the smallest of a sorted array of 16-bit numbers, a bitmap of 65,536 bits and a list of runs, so a sparse
set takes two bytes a member, a dense one at most 8 KB for 65,536 and a span of numbers four bytes.  No row exceeds 8 KB
and a set of any size is spread over its containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 16
ARRAY, BITS, RUNS = 0, 1, 2
#: Words of 64 bits that a task unpacks at a time.
TOGETHER = 1 << 17
CONTAINER = ("high", "kind", "n", "data")
CONTAINER_TYPE = "high bigint, kind tinyint, n int, data binary"
#: What stays of a container that only one side has: (of the left, of the right).
ALONE = {"and": (False, False), "or": (True, True), "xor": (True, True), "andnot": (True, False)}


def pack(values: np.ndarray) -> tuple[int, bytes]:
    """The smallest container of distinct sorted numbers below 65,536."""
    starts = np.flatnonzero(np.diff(values, prepend=-2) != 1)
    if 4 * len(starts) < min(2 * len(values), SPAN // 8):
        last = np.append(starts[1:], len(values)) - 1
        return RUNS, np.stack([values[starts], values[last]], axis=1).astype("<u2").tobytes()
    if 2 * len(values) <= SPAN // 8:
        return ARRAY, values.astype("<u2").tobytes()
    mask = np.zeros(SPAN, bool)
    mask[values] = True
    return BITS, np.packbits(mask, bitorder="little").tobytes()


def unpack(kind: int, data: bytes) -> np.ndarray:
    if kind == BITS:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    numbers = np.frombuffer(data, "<u2").astype(np.int64)
    if kind == ARRAY:
        return numbers
    first, last = numbers[0::2], numbers[1::2]
    sizes = last - first + 1
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def merged(op: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mask = np.zeros(SPAN, np.uint8)
    mask[a] = 1
    mask[b] |= 2
    wanted = {"and": mask == 3, "or": mask > 0, "xor": (mask == 1) | (mask == 2), "andnot": mask == 1}
    return np.flatnonzero(wanted[op])


def _fields(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _containers(words: DataFrame, keys: list[str]) -> DataFrame:
    """Containers of rows (keys, high, word, bits): 64 bits of a container, at most 1,024 rows each."""
    lists = words.groupBy(*keys, "high").agg(F.collect_list(F.struct("word", "bits")).alias("words"))

    def run(batches):
        for batch in batches:
            items = batch.column(len(keys) + 1)
            offsets = items.offsets.to_numpy()
            at = 0
            while at < len(items):
                end = max(int(np.searchsorted(offsets, offsets[at] + TOGETHER, "right")) - 1, at + 1)
                part = items.slice(at, end - at)
                flat = part.flatten()
                of = np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1]))
                bits = np.unpackbits(flat.field("bits").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, bit = np.nonzero(bits)
                numbers = np.sort(of[row] * SPAN + flat.field("word").to_numpy()[row].astype(np.int64) * 64 + bit)
                cuts = np.searchsorted(numbers, np.arange(end - at + 1) * SPAN)
                packed = [pack(numbers[a:b] - i * SPAN) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                columns = [batch.column(i).slice(at, end - at) for i in range(len(keys) + 1)]
                columns += [pa.array([k for k, _ in packed], pa.int8()), pa.array(np.diff(cuts), pa.int32()), pa.array([d for _, d in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, *CONTAINER])
                at = end

    return lists.mapInArrow(run, _fields(words, keys) + CONTAINER_TYPE)


def bitmap_build(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """(group, high, kind, n, data): the set of a group's integers; NULL is no member.

    Rows meet as words of 64 bits, which each task combines before the shuffle.
    """
    x = F.col(column).cast("bigint")
    rows = df.where(F.col(column).isNotNull()).select(
        *group, F.shiftright(x, 16).alias("high"), F.shiftright(x.bitwiseAND(F.lit(SPAN - 1)), 6).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, CAST(CAST(`{column}` AS BIGINT) & 63L AS INT))").alias("bits"))
    return _containers(rows.groupBy(*group, "high", "word").agg(F.bit_or("bits").alias("bits")), group)


def _words(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, high, word, bits) of some containers: the 64 bits of each word that has members."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            kinds, data = batch.column(len(keys) + 1).to_pylist(), batch.column(len(keys) + 3).to_pylist()
            ends = np.cumsum(batch.column(len(keys) + 2).to_numpy().astype(np.int64))
            start = 0
            while start < len(kinds):
                before = int(ends[start - 1]) if start else 0
                end = max(int(np.searchsorted(ends, before + TOGETHER, "right")), start + 1)
                numbers = [unpack(k, d) for k, d in zip(kinds[start:end], data[start:end])]
                row = np.repeat(np.arange(start, end), [len(x) for x in numbers])
                numbers = np.concatenate(numbers)
                first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(numbers >> 6, prepend=-1) != 0))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (numbers & 63).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
                at = pa.array(row[first])
                columns = [batch.column(i).take(at) for i in range(len(keys) + 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((numbers[first] >> 6).astype(np.int32)), pa.array(bits.view(np.int64))], [*keys, "high", "word", "bits"])
                start = end

    rows = bitmaps.select(*keys, *CONTAINER)
    return rows.mapInArrow(run, _fields(rows, keys) + "high bigint, word int, bits bigint")


def bitmap_rollup(bitmaps: DataFrame, group: list[str]) -> DataFrame:
    """The union of the sets of a coarser group."""
    return _containers(_words(bitmaps, group).groupBy(*group, "high", "word").agg(F.bit_or("bits").alias("bits")), group)


def bitmap_cardinality(bitmaps: DataFrame, group: list[str], out: str = "cardinality") -> DataFrame:
    """Members per group, from the containers' sizes alone; groups of several sets need ``bitmap_rollup`` first."""
    return bitmaps.groupBy(*group).agg(F.sum("n").alias(out))


def bitmap_combine(left: DataFrame, right: DataFrame, keys: list[str], op: str) -> DataFrame:
    """``and``, ``or``, ``xor`` or ``andnot`` of the sets of two tables per key (NULL keys are equal).

    Only containers that both sides have are unpacked.  A key left without members has no rows.
    """
    if op not in ALONE:
        raise ValueError(f"op is one of {', '.join(ALONE)}")
    held = F.struct("kind", "n", "data")
    none = F.lit(None).cast("struct<kind:tinyint,n:int,data:binary>")
    sides = left.select(*keys, "high", held.alias("a"), none.alias("b")).unionByName(right.select(*keys, "high", none.alias("a"), held.alias("b")))
    pairs = sides.groupBy(*keys, "high").agg(F.any_value("a", True).alias("a"), F.any_value("b", True).alias("b"))
    wanted = F.when(F.col("b").isNull(), F.lit(ALONE[op][0])).when(F.col("a").isNull(), F.lit(ALONE[op][1])).otherwise(True)

    @F.pandas_udf("kind tinyint, n int, data binary")
    def combined(ak: pd.Series, ad: pd.Series, bk: pd.Series, bd: pd.Series) -> pd.DataFrame:
        out = []
        for k, d, m, e in zip(ak, ad, bk, bd):
            if d is None or e is None:  # held by one side: stays as it is
                out.append((ARRAY, -1, None))
            else:
                numbers = merged(op, unpack(k, d), unpack(m, e))
                kind, packed = pack(numbers)
                out.append((kind, len(numbers), packed))
        return pd.DataFrame(out, columns=["kind", "n", "data"])

    both = combined(F.coalesce("a.kind", F.lit(-1)), F.col("a.data"), F.coalesce("b.kind", F.lit(-1)), F.col("b.data"))
    found = pairs.where(wanted).withColumn("both", both).withColumn("set", F.when(F.col("both.n") < 0, F.coalesce("a", "b")).otherwise(F.col("both")))
    return found.where("set.n > 0").select(*keys, "high", "set.kind", "set.n", "set.data")


def bitmap_members(bitmaps: DataFrame, keys: list[str], out: str = "member") -> DataFrame:
    """A row per member of each set."""

    @F.pandas_udf("array<int>")
    def low(kind: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([unpack(k, d).astype(np.int32) for k, d in zip(kind, data)])

    rows = bitmaps.select(*keys, "high", F.explode(low("kind", "data")).alias("low"))
    return rows.select(*keys, (F.shiftleft("high", 16).bitwiseOR(F.col("low").cast("bigint"))).alias(out))


def bitmap_contains(bitmaps: DataFrame, rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Those of ``rows`` whose number is in the set of their keys; each row meets one word of 64 bits, not a container."""
    fresh = "_asked"
    while any(c.startswith(fresh) for c in rows.columns):
        fresh = "_" + fresh
    x = F.col(column).cast("bigint")
    asked = rows.where(x.isNotNull())
    held = _words(bitmaps, keys).select(*[F.col(k).alias(f"{fresh}{i}") for i, k in enumerate(keys)], F.col("high").alias(f"{fresh}_high"),
                                        F.col("word").alias(f"{fresh}_word"), F.col("bits").alias(f"{fresh}_bits"))
    same = (F.shiftright(x, 16) == F.col(f"{fresh}_high")) & (F.shiftright(x.bitwiseAND(F.lit(SPAN - 1)), 6).cast("int") == F.col(f"{fresh}_word"))
    for i, k in enumerate(keys):
        same = same & asked[k].eqNullSafe(F.col(f"{fresh}{i}"))
    held_bit = F.expr(f"shiftrightunsigned(`{fresh}_bits`, CAST(CAST(`{column}` AS BIGINT) & 63L AS INT)) & 1L")
    return asked.join(held, same).where(held_bit == 1).select(*[asked[c] for c in rows.columns])

"""Ordered (window) work that stays parallel when one key holds much of the table.

A native window sends every row of a key to one task.  Here a cheap count finds
the keys above ``hot_rows``.  All other keys use the native window.  Rows of hot
keys are cut into chunks by a range partitioning on (keys, order), windows run
inside the chunks, and a small table with one row per (key, chunk) carries the
state of earlier chunks forward.  Peers of the order never straddle a chunk, so
rank functions stay exact.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.session import stage

HOT_ROWS = 2_000_000
# default of spark.sql.optimizer.windowGroupLimitThreshold
MAP_SIDE_K = 1000


def null_safe(left: DataFrame, right: DataFrame, pairs) -> Column:
    """Conjunction of ``<=>`` over (left column, right column) pairs."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs], F.lit(True))


def split_hot(df: DataFrame, keys: list[str], order: list[Column], hot_rows: int = HOT_ROWS):
    """(rows of ordinary keys, chunked rows of hot keys or None).

    There are at most ``rows / hot_rows`` hot keys; they are written as a table and
    the planner decides how to join them.
    """
    if not keys:
        total = df.count()
        if total <= hot_rows:
            return df, None
        cold, hot, hot_total = None, df, total
    else:
        counts = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
                  .where(F.col("_rows") > hot_rows))
        found = counts.agg(F.count(F.lit(1)), F.sum("_rows")).first()
        if found[0] == 0:
            return df, None
        hot_total = found[1]
        renamed = counts.select(*[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)])
        hot_keys = stage(renamed, "hot-keys")
        on = null_safe(df, hot_keys, [(k, f"_hot_{i}") for i, k in enumerate(keys)])
        cold, hot = df.join(hot_keys, on, "left_anti"), df.join(hot_keys, on, "left_semi")
    chunks = 2 * math.ceil(hot_total / hot_rows)
    chunked = (hot.repartitionByRange(chunks, *[F.col(k) for k in keys], *order)
               .withColumn("_chunk", F.spark_partition_id()))
    return cold, stage(chunked, "hot-rows")


def _merge(cold: DataFrame | None, hot: DataFrame) -> DataFrame:
    return hot if cold is None else cold.unionByName(hot)


_LOCAL = {
    "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}
_CARRY = {**_LOCAL, "count": F.sum}


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "first":
        return F.coalesce(carried, local)
    if kind == "min":
        return F.least(local, carried)
    if kind == "max":
        return F.greatest(local, carried)
    return F.coalesce(local + carried, local, carried)


def running(df: DataFrame, keys: list[str], order: list[Column],
            outputs: dict[str, tuple[str, Column]], inclusive: bool = True,
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running sum / count / min / max / first / last non-NULL from the start of the key.

    ``inclusive=False`` leaves the current row out of its own frame.  ``order`` must be unique per key.
    """
    end = Window.currentRow if inclusive else -1
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    cold, hot = split_hot(df, keys, order, hot_rows)

    def native(rows):
        return rows.select("*", *[_LOCAL[kind](c).over(frame).alias(name)
                                  for name, (kind, c) in outputs.items()])

    if hot is None:
        return native(cold)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    closed = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = (hot.select(*keys, "_chunk", F.lead(F.lit(True)).over(inside).isNull().alias("_end"),
                        *[_LOCAL[kind](c).over(closed).alias(name) for name, (kind, c) in outputs.items()])
             .where("_end"))
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = stage(ended.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"),
        *[_CARRY[kind](F.col(name)).over(before).alias(f"_carry_{name}")
          for name, (kind, _) in outputs.items()]), "carry")
    local = hot.select("*", *[_LOCAL[kind](c).over(inside.rowsBetween(Window.unboundedPreceding, end))
                              .alias(name) for name, (kind, c) in outputs.items()])
    on = null_safe(local, carry, [(k, f"_k{i}") for i, k in enumerate(keys)] + [("_chunk", "_c")])
    joined = local.join(carry, on, "left")
    kinds = native(hot.drop("_chunk")).schema  # a key's size must not change a type
    result = joined.select(*[joined[c] for c in df.columns],
                           *[_combine(kind, joined[name], joined[f"_carry_{name}"]).cast(kinds[name].dataType).alias(name)
                             for name, (kind, _) in outputs.items()])
    if any(kind == "count" for kind, _ in outputs.values()):
        result = result.fillna(0, [n for n, (kind, _) in outputs.items() if kind == "count"])
    return _merge(None if cold is None else native(cold), result)


def numbered(df: DataFrame, keys: list[str], order: list[Column], row_number: str | None = "rn",
             rank: str | None = None, dense_rank: str | None = None,
             ntile: tuple[str, int] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """row_number, rank, dense_rank and ntile per key."""
    wanted = [(row_number, F.row_number, "_n"), (rank, F.rank, "_n"), (dense_rank, F.dense_rank, "_d")]
    wanted = [(name, fn, carried) for name, fn, carried in wanted if name]
    window = Window.partitionBy(*keys).orderBy(*order)
    cold, hot = split_hot(df, keys, order, hot_rows)

    def native(rows):
        tiles = [F.ntile(ntile[1]).over(window).cast("long").alias(ntile[0])] if ntile else []
        return rows.select("*", *[fn().over(window).cast("long").alias(name) for name, fn, _ in wanted], *tiles)

    if hot is None:
        return native(cold)
    result = _number_chunks(hot, keys, order, df.columns, wanted, ntile)
    return _merge(None if cold is None else native(cold), result)


def _number_chunks(hot: DataFrame, keys: list[str], order: list[Column], columns: list[str], wanted,
                   ntile: tuple[str, int] | None = None) -> DataFrame:
    """Numbers within chunked rows: the number inside the chunk plus what earlier chunks of the key hold."""
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = hot.select("*", F.row_number().over(inside).cast("long").alias("_rn"),
                       F.dense_rank().over(inside).cast("long").alias("_dr"),
                       F.rank().over(inside).cast("long").alias("_rk"))
    sums = local.groupBy(*keys, "_chunk").agg(F.max("_rn").alias("_n"), F.max("_dr").alias("_d"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = stage(sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d"),
        F.sum("_n").over(by_key).alias("_total")), "carry")
    on = null_safe(local, carry, [(k, f"_k{i}") for i, k in enumerate(keys)] + [("_chunk", "_c")])
    joined = local.join(carry, on)
    local_of = {F.row_number: "_rn", F.rank: "_rk", F.dense_rank: "_dr"}
    numbers = [(F.col(local_of[fn]) + F.col(carried)).alias(name) for name, fn, carried in wanted]
    if ntile:
        numbers.append(_tile(F.col("_rn") + F.col("_n"), F.col("_total"), ntile[1]).alias(ntile[0]))
    return joined.select(*[joined[c] for c in columns], *numbers)


def _tile(position: Column, total: Column, n: int) -> Column:
    """ntile from position and group size: the first ``total % n`` tiles get one row more."""
    small = F.floor(total / n)
    larger = total % n
    border = larger * (small + 1)
    return (F.when(position <= border, F.floor((position - 1) / (small + 1)) + 1)
            .otherwise(larger + F.floor((position - border - 1) / small) + 1)).cast("long")


def framed(df: DataFrame, keys: list[str], order: list[Column], build, preceding: int = 0,
           following: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Any window expressions that look at most ``preceding`` / ``following`` rows away.

    ``build(window)`` returns {name: Column}.  Hot keys are cut into full pages; each page
    also receives a copy of the few rows its frames can reach in its neighbours.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    cold, hot = split_hot(df, keys, order, hot_rows)

    def native(rows):
        return rows.select("*", *[c.alias(n) for n, c in build(window).items()])

    if hot is None:
        return native(cold)
    page_rows = max(hot_rows, preceding, following, 1)
    placed = _number_chunks(hot, keys, order, df.columns, [("_rn", F.row_number, "_n")])
    offset = (F.col("_rn") - 1) % page_rows
    page = F.floor((F.col("_rn") - 1) / page_rows).cast("long")
    copies = F.array(
        F.struct(page.alias("page"), F.lit(False).alias("halo")),
        F.struct(F.when(offset >= page_rows - preceding, page + 1).alias("page"), F.lit(True).alias("halo")),
        F.struct(F.when(offset < following, page - 1).alias("page"), F.lit(True).alias("halo")))
    spread = (placed.select(*df.columns, F.inline(copies).alias("_page", "_halo"))
              .where(F.col("_page").isNotNull()))
    inside = Window.partitionBy(*keys, "_page").orderBy(*order)
    result = (spread.select("*", *[c.alias(n) for n, c in build(inside).items()])
              .where(~F.col("_halo")).drop("_page", "_halo"))
    return _merge(None if cold is None else native(cold), result)


def range_framed(df: DataFrame, keys: list[str], value: str, build, preceding: int = 0, following: int = 0,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Window expressions over RANGE frames of an integer column, at most ``preceding`` / ``following`` away.

    Hot keys are cut into value stripes as wide as the frame; rows within reach of the next stripe are copied to it.
    """
    order = [F.col(value).asc()]
    cold, hot = split_hot(df, keys, order, hot_rows)

    def native(rows):
        window = Window.partitionBy(*keys).orderBy(*order)
        return rows.select("*", *[c.alias(n) for n, c in build(window).items()])

    if hot is None:
        return native(cold)
    width = max(preceding, following, 1)
    stripe = F.floor(F.col(value) / width).cast("long")
    offset = F.col(value) - stripe * width
    copies = F.array(
        F.struct(stripe.alias("stripe"), F.lit(False).alias("halo")),
        F.struct(F.when(offset >= width - preceding, stripe + 1).alias("stripe"), F.lit(True).alias("halo")),
        F.struct(F.when(offset <= following - 1, stripe - 1).alias("stripe"), F.lit(True).alias("halo")))
    spread = (hot.select(*df.columns, F.inline(copies).alias("_stripe", "_halo"))
              .where(F.col("_stripe").isNotNull() | ~F.col("_halo")))
    inside = Window.partitionBy(*keys, "_stripe").orderBy(*order)
    result = (spread.select("*", *[c.alias(n) for n, c in build(inside).items()])
              .where(~F.col("_halo")).drop("_stripe", "_halo"))
    return _merge(None if cold is None else native(cold), result)


def paged(df: DataFrame, keys: list[str], order: list[Column], page_rows: int,
          hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``page``: consecutive pages of at most ``page_rows`` rows per key, so that
    collecting a page is bounded however large the key is."""
    placed = numbered(df, keys, order, row_number="_rn", hot_rows=hot_rows)
    return placed.withColumn("page", F.floor((F.col("_rn") - 1) / page_rows).cast("long"))


def topk(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """Top ``k`` rows per key.

    Up to ``MAP_SIDE_K`` rows Catalyst cuts each map task to ``k`` rows per key before the shuffle; above
    that it does not, and the numbering that splits hot keys takes over.
    """
    if k > MAP_SIDE_K:
        return numbered(df, keys, order, row_number=name).where(F.col(name) <= k)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("long")).where(F.col(name) <= k)


def nth_from_last(df: DataFrame, keys: list[str], reverse_order: list[Column], column: str, n: int,
                  name: str) -> DataFrame:
    """``column`` of the n-th row counted from the end of the key, on every row.

    ``reverse_order`` sorts the last row first.  One row per key comes out of the map-side cut
    to ``n`` rows and is joined back.
    """
    picked = (topk(df, keys, reverse_order, n, "_back").where(F.col("_back") == n)
              .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(column).alias(name)))
    on = null_safe(df, picked, [(k, f"_k{i}") for i, k in enumerate(keys)])
    return df.join(picked, on, "left").select(*[df[c] for c in df.columns], picked[name])

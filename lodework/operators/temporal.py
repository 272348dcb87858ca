"""System-versioned tables and period checks.  Periods are half-open; a NULL end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.operators.ordered import HOT_ROWS, framed, null_safe, running


def apply_changes(current: DataFrame, history: DataFrame, changes: DataFrame, keys: list[str], ts: str, seq: str,
                  op: str = "op", hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(current, history) after a batch of changes.

    ``current`` holds keys, values and valid_from; ``history`` also valid_to.  ``changes`` hold keys,
    values, the time, a sequence number that orders equal times, and an operation: insert and update
    open a version, delete only closes one.  The next change of a key ends each version.
    """
    values = [c for c in current.columns if c not in (*keys, "valid_from")]
    # keys without a change pass through
    touched = changes.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    same = null_safe(current, touched, [(k, f"_k_{k}") for k in keys])
    rest, current = current.join(touched, same, "left_anti"), current.join(touched, same, "left_semi")
    open_rows = current.select(*keys, *values, F.col("valid_from").alias("_at"), F.lit(-1).cast("long").alias("_seq"), F.lit("open").alias("_op"))
    new_rows = changes.select(*keys, *values, F.col(ts).alias("_at"), F.col(seq).cast("long").alias("_seq"), F.lower(F.col(op)).alias("_op"))
    ended = framed(open_rows.unionByName(new_rows), keys, [F.asc("_at"), F.asc("_seq")],
                   lambda w: {"_until": F.lead("_at").over(w)}, following=1, hot_rows=hot_rows)
    versions = ended.where("_op <> 'delete'")
    now = versions.where("_until IS NULL").select(*keys, *values, F.col("_at").alias("valid_from"))
    past = versions.where("_until IS NOT NULL").select(*keys, *values, F.col("_at").alias("valid_from"), F.col("_until").alias("valid_to"))
    return rest.select(*now.columns).unionByName(now), history.unionByName(past)


def as_of(current: DataFrame, history: DataFrame, moment: Column) -> DataFrame:
    """Rows valid at an instant, without joins: a filter on both tables."""
    live = current.where(F.col("valid_from") <= moment).withColumn("valid_to", F.lit(None).cast(current.schema["valid_from"].dataType))
    past = history.where((F.col("valid_from") <= moment) & (moment < F.col("valid_to")))
    return live.unionByName(past)


def _earlier_end(df: DataFrame, keys: list[str], start: str, end: str, tie: list[Column], hot_rows: int) -> DataFrame:
    """Adds the latest end among earlier periods of the key; an open end counts as infinitely late."""
    marked = df.withColumn("_end", F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("at")))
    return running(marked, keys, [F.col(start).asc(), F.col(end).asc_nulls_last(), *tie], {"_before": ("max", F.col("_end"))},
                   inclusive=False, hot_rows=hot_rows)


def period_violations(df: DataFrame, keys: list[str], start: str, end: str, tie: list[Column] | None = None,
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with ``violation``: inverted (start not before end), overlap with an earlier period, or a gap before it.

    Inverted periods are left out of the other two checks.
    """
    inverted = F.col(end).isNotNull() & (F.col(start) >= F.col(end))
    bad = df.where(inverted).withColumn("violation", F.lit("inverted"))
    seen = _earlier_end(df.where(~inverted), keys, start, end, tie or [], hot_rows)
    kind = (F.when(F.col("_before").isNull(), None)
            .when(F.col("_before.open") | (F.col(start) < F.col("_before.at")), "overlap")
            .when(F.col(start) > F.col("_before.at"), "gap"))
    found = seen.withColumn("violation", kind).where(F.col("violation").isNotNull()).select(*df.columns, "violation")
    return bad.unionByName(found)


def coalesce_periods(df: DataFrame, keys: list[str], start: str, end: str, tie: list[Column] | None = None,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, start, end, periods): touching or overlapping periods of a key merged into one."""
    valid = df.where(F.col(end).isNull() | (F.col(start) < F.col(end)))
    seen = _earlier_end(valid, keys, start, end, tie or [], hot_rows)
    fresh = F.col("_before").isNull() | (~F.col("_before.open") & (F.col(start) > F.col("_before.at")))
    flagged = seen.withColumn("_fresh", fresh.cast("int"))
    islands = running(flagged, keys, [F.col(start).asc(), F.col(end).asc_nulls_last(), *(tie or [])],
                      {"_island": ("sum", F.col("_fresh"))}, hot_rows=hot_rows)
    merged = islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max("_end").alias("_last"), F.count(F.lit(1)).alias("periods"))
    return merged.select(*keys, start, F.when(~F.col("_last.open"), F.col("_last.at")).alias(end), "periods")

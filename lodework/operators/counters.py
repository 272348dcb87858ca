"""Deltas of cumulative counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.operators.ordered import HOT_ROWS, framed


def snapshot_delta(df: DataFrame, keys: list[str], ts: str, counters: list[str], tie: list[Column] | None = None,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``<counter>_delta``: growth since the previous snapshot of the key.

    A falling counter was reset, so its delta is the current value; the first snapshot has none.
    """
    order = [F.col(ts).asc(), *(tie or [])]

    def build(window):
        return {f"_prev_{c}": F.lag(c).over(window) for c in counters}

    with_prev = framed(df, keys, order, build, preceding=1, hot_rows=hot_rows)
    deltas = [F.when(F.col(c) < F.col(f"_prev_{c}"), F.col(c)).otherwise(F.col(c) - F.col(f"_prev_{c}")).alias(f"{c}_delta")
              for c in counters]
    return with_prev.select(*df.columns, *deltas)

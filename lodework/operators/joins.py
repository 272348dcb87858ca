"""Join strategies and the as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.operators.ordered import HOT_ROWS, running
from lodework.operators.tabular import all_of

STRATEGIES = {"broadcast": "broadcast", "merge": "merge", "shuffle_hash": "shuffle_hash", None: None}


def hinted_join(left: DataFrame, right: DataFrame, on, strategy: str | None = None, how: str = "inner",
                broadcast_rows: int = 1_000_000, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """Equi-join with a strategy chosen by the caller; ``None`` switches the hint off.

    ``broadcast`` is honoured only after a count shows that the right side is within ``broadcast_rows`` and, as JSON
    text, within ``broadcast_bytes``; a larger side falls back to a merge join.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {list(STRATEGIES)}")
    if strategy == "broadcast":
        size = right.limit(broadcast_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
        if size.n > broadcast_rows or (size.b or 0) > broadcast_bytes:
            strategy = "merge"
    return left.join(right if strategy is None else right.hint(STRATEGIES[strategy]), on, how)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, tie: list[str],
              columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each left row with ``columns`` of the newest right row of equal ``by`` and ``ts`` not later.

    Both sides are stacked in one time order and the last right row is carried forward: one shuffle,
    no non-equi join, and hot keys are split.  ``tie`` makes the order of left rows unique;
    among right rows of one instant the last by all of ``columns`` wins.  A NULL key or time matches
    nothing: such a left row keeps NULLs.
    """
    whole = all_of([F.col(c).isNotNull() for c in (*by, ts)])
    lone = left.where(~whole).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns])
    left, right = left.where(whole), right.where(whole)
    def side(df, is_left):
        payload = (F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType) if is_left
                   else F.struct(*[right[c] for c in columns]))
        extra = [F.col(c) if is_left else F.lit(None).cast(left.schema[c].dataType).alias(c)
                 for c in left.columns if c not in (*by, ts)]
        return df.select(*by, ts, F.lit(int(is_left)).alias("_side"), payload.alias("_pay"), *extra)

    stacked = side(left, True).unionByName(side(right, False))
    order = [F.col(ts).asc(), F.col("_side").asc(), F.col("_pay").asc(), *[F.col(c).asc() for c in tie]]
    filled = running(stacked, by, order, {"_last": ("last", F.col("_pay"))}, hot_rows=hot_rows)
    return filled.where("_side = 1").select(*left.columns, *[F.col("_last")[c].alias(c) for c in columns]).unionByName(lone)



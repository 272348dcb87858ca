"""Message queues as an operation log.

ops(queue, msg_id, op, ts, message): ``send`` adds a message, ``read`` hides it for a timeout, ``archive``
moves it out of the queue, ``delete`` removes it.  The state of a message depends only on its own
operations, so work spreads over messages even when one queue holds most of them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lodework.operators.ordered import HOT_ROWS, numbered

OPS = "queue string, msg_id bigint, op string, ts timestamp_ntz, message string"


def send(ops: DataFrame, messages: DataFrame, queue: str, message: str, ts: str, order: list[Column],
         hot_rows: int = HOT_ROWS) -> DataFrame:
    """Log with new messages; ids go on from the highest id of each queue, in the given order."""
    top = ops.groupBy(F.col("queue").alias("_q")).agg(F.max("msg_id").alias("_top"))
    placed = numbered(messages, [queue], order, row_number="_n", hot_rows=hot_rows)
    rows = placed.join(top, F.col(queue) == F.col("_q"), "left").select(
        F.col(queue).alias("queue"), (F.coalesce("_top", F.lit(0)) + F.col("_n")).alias("msg_id"), F.lit("send").alias("op"),
        F.col(ts).cast("timestamp_ntz").alias("ts"), F.col(message).alias("message"))
    return ops.unionByName(rows)


def queue_state(ops: DataFrame, visibility: str = "30 seconds") -> DataFrame:
    """One row per message: message, sent_at, read_count, visible_at, gone_at and ``place`` (queue, archive or none).

    Plain aggregates, so it runs alike on a table and as a stream in update mode.
    """
    kind, at = F.col("op"), F.col("ts")
    last_read = F.max(F.when(kind == "read", at))
    state = ops.groupBy("queue", "msg_id").agg(
        F.max(F.when(kind == "send", F.col("message"))).alias("message"), F.min(F.when(kind == "send", at)).alias("sent_at"),
        F.count_if(kind == "read").alias("read_count"), last_read.alias("_read"),
        F.min(F.when(kind.isin("archive", "delete"), at)).alias("gone_at"),
        F.coalesce(F.max((kind == "archive")), F.lit(False)).alias("_archived"))
    place = (F.when(F.col("sent_at").isNull(), "none").when(F.col("gone_at").isNull(), "queue").when(F.col("_archived"), "archive").otherwise("none"))
    visible = F.coalesce(F.col("_read") + F.expr(f"interval {visibility}"), F.col("sent_at"))
    return state.select("queue", "msg_id", "message", "sent_at", "read_count", visible.alias("visible_at"), "gone_at", place.alias("place"))


def read(ops: DataFrame, queue: str, now: dt.datetime, quantity: int, visibility: str = "30 seconds") -> tuple[DataFrame, DataFrame]:
    """(messages, log after the read): the visible messages of lowest id, which are then hidden."""
    moment = F.lit(now.isoformat()).cast("timestamp_ntz")
    visible = queue_state(ops.where(F.col("queue") == queue), visibility).where((F.col("place") == "queue") & (F.col("visible_at") <= moment))
    taken = visible.orderBy("msg_id").limit(quantity).select("queue", "msg_id", "message")
    log = ops.unionByName(taken.select("queue", "msg_id", F.lit("read").alias("op"), moment.alias("ts"), F.lit(None).cast("string").alias("message")))
    return taken, log


def archive(ops: DataFrame, messages: DataFrame, now: dt.datetime) -> DataFrame:
    """Log after the given (queue, msg_id) rows moved to the archive."""
    return ops.unionByName(messages.select("queue", "msg_id", F.lit("archive").alias("op"),
                                           F.lit(now.isoformat()).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("message")))


def drop_queue(ops: DataFrame, queue: str) -> DataFrame:
    return ops.where(F.col("queue") != queue)


RETURNS = "queue string, msg_id bigint, visible_again timestamp"
STATE = "hidden_until bigint"


def expired_reads(ops: DataFrame, visibility_seconds: int, watermark: str = "0 seconds") -> DataFrame:
    """Stream of (queue, msg_id, visible_again): messages read, not archived, and visible again.

    One small state per message; event-time timers fire when the watermark passes the timeout.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            until = state.get[0]
            state.remove()
            yield pd.DataFrame({"queue": [key[0]], "msg_id": [key[1]], "visible_again": [pd.Timestamp(until, unit="ms")]})
            return
        gone, last = False, state.get[0] if state.exists else None
        for batch in batches:
            gone = gone or batch["op"].isin(["archive", "delete"]).any()
            reads = batch.loc[batch["op"] == "read", "ts"]
            if len(reads):
                until = int(reads.max().timestamp() * 1000) + visibility_seconds * 1000
                last = until if last is None else max(last, until)
        if gone:
            if state.exists:
                state.remove()
        elif last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        return
        yield  # pragma: no cover

    timed = ops.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy("queue", "msg_id").applyInPandasWithState(step, RETURNS, STATE, "append", GroupStateTimeout.EventTimeTimeout)

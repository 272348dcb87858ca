"""Views kept current by Structured Streaming.

The state store keeps the aggregate per group; each micro-batch writes only the groups it changed to
``<path>/batch=<id>``.  A repeated batch overwrites its own folder, so results count once.  Reading
takes the newest row per group; ``compact_view`` folds old batches together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.session import scratch_path


def run_to_end(stream: DataFrame, path: str, mode: str = "update", checkpoint: str | None = None,
               write: Callable[[DataFrame, int], None] | None = None, partitions: int | None = None) -> int:
    """Process everything that is available now, then stop.  Returns how many rows came later than the watermark.

    ``partitions`` fixes the number of state partitions at the first start (default: that of the session).
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    setting = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(setting)
    try:
        spark.conf.set(setting, str(partitions or usual))
        query = (stream.writeStream.outputMode(mode).foreachBatch(write or keep)
                 .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(setting, usual)
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)


def read_view(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per group of a view."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return newest.select(*keys, *[F.col("_row")[v].alias(v) for v in values])


def compact_view(spark: SparkSession, path: str, out_path: str, keys: list[str]) -> DataFrame:
    """The view as one batch in a new folder."""
    read_view(spark, path, keys).write.mode("errorifexists").parquet(f"{out_path}/batch={0:012d}")
    return read_view(spark, out_path, keys)


def incremental_view(stream: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """GROUP BY kept current: works alike on a stream and on a table."""
    return stream.groupBy(*keys).agg(*aggs)


def signed_view(stream: DataFrame, keys: list[str], sign: str, sums: dict[str, str]) -> DataFrame:
    """Counts and sums over inserts (+1) and deletes (-1); a group with no rows left has row_count 0.

    Only invertible aggregates: a deleted minimum cannot be taken back.
    """
    weight = F.col(sign)
    return stream.groupBy(*keys).agg(F.sum(weight).alias("row_count"),
                                     *[F.sum(F.col(c) * weight).alias(name) for name, c in sums.items()])


def refresh_groups(view: DataFrame, base: DataFrame, touched: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """View in which the groups named in ``touched`` are computed anew from the base table.

    For aggregates a delete cannot undo (min, max, distinct counts): only the rows of touched groups are read again.
    """
    names = touched.select(*keys).distinct()
    fresh = base.join(names, keys, "left_semi").groupBy(*keys).agg(*aggs)
    return view.join(names, keys, "left_anti").unionByName(fresh)


def time_bucket_agg(df: DataFrame, ts: str, every: str, keys: list[str], aggs: list[Column],
                    watermark: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates per time bucket, for a table or a stream.

    On a stream the watermark bounds the state: rows later than it are dropped.  ``ts`` is made an
    instant, which event time needs.
    """
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark(ts, watermark)
    bucket = F.window(F.col(ts), every, slide) if slide else F.window(F.col(ts), every)
    grouped = timed.groupBy(bucket.alias("_w"), *keys).agg(*aggs)
    return grouped.select(F.col("_w.start").cast("timestamp_ntz").alias("bucket"), *[c for c in grouped.columns if c != "_w"])


def rollup_buckets(buckets: DataFrame, unit: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Coarser buckets from finer ones, without the raw rows."""
    return buckets.groupBy(F.date_trunc(unit, "bucket").cast("timestamp_ntz").alias("bucket"), *keys).agg(*[F.sum(c).alias(c) for c in sums])

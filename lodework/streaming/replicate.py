"""Continuous replication: a feed of changes applied to stored copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.streaming.feeds import ReplicationSet, latest_changes
from lodework.streaming.views import run_to_end


def replicate_tables(changes: DataFrame, subscribed: ReplicationSet, path: str) -> None:
    """Run the feed to its end: each micro-batch writes the last change per key of each subscribed table
    to ``<path>/<table>/batch=<id>``.  A repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, (keys, schema) in subscribed.tables.items():
            (latest_changes(batch, name, keys, schema).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id:012d}"))
        batch.unpersist()

    run_to_end(changes, path, mode="append", write=write)


def read_copy(spark: SparkSession, path: str, table: str, subscribed: ReplicationSet) -> DataFrame:
    """Current rows of a copy: the change of highest position per key, unless it is a delete."""
    keys, _ = subscribed.tables[table]
    rows = spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}").drop("batch")
    values = [c for c in rows.columns if c not in (*keys, "pos")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "pos").alias("_row"))
    return newest.where("_row.kind <> 'delete'").select(*keys, *[F.col("_row")[v].alias(v) for v in values if v != "kind"])



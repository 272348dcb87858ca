"""File scans and writes: Parquet, CSV, JSON, ORC; partitioned layout; compaction; retention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None,
               where: Column | str | None = None) -> DataFrame:
    """Columnar scan; the filter and the column list reach the Parquet reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_files(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str,
               keep_bad: bool = False, **options) -> DataFrame:
    """CSV / JSON / ORC / Parquet with a declared schema.

    ``keep_bad`` adds the text of rows that do not fit the schema as ``_corrupt_record``;
    otherwise such rows stop the read.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        if keep_bad:
            schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
            reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        else:
            reader = reader.option("mode", "FAILFAST")
    return reader.schema(schema).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: list[str] | None = None, **options) -> None:
    """Copy a table or query result out to files."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_partitioned(df: DataFrame, path: str, column: str, interval: str = "day",
                      mode: str = "overwrite") -> str:
    """Range-partitioned layout by a time interval; only the partitions present in ``df`` are replaced.

    The rebalance hint gathers small partitions into few files and splits a heavy one over tasks.
    Returns the name of the partition column.
    """
    part = f"{column}_{interval}"
    value = F.date_trunc(interval, F.col(column))
    if interval in ("hour", "minute", "second"):
        value = F.date_format(value, "yyyy-MM-dd-HH-mm-ss")
    else:
        value = value.cast("date")
    laid_out = df.withColumn(part, value).hint("rebalance", part)
    (laid_out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(part).parquet(path))
    return part


def fingerprint(df: DataFrame):
    """(rows, order-free hash): equal for equal bags of rows."""
    hashed = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)), F.sum(hashed), F.sum(hashed * hashed % 1_000_003)).first()
    return row[0], row[1], row[2]


def compact(spark: SparkSession, path: str, out_path: str, sort_cols: list[str],
            target_rows: int = 5_000_000) -> DataFrame:
    """Rewrite a table into few clustered files at ``out_path`` and check that no row changed.

    A row hash after the sort columns splits heavy ties over several files.
    """
    df = spark.read.parquet(path)
    before = fingerprint(df)
    files = max(1, math.ceil(before[0] / target_rows))
    order = [F.col(c) for c in sort_cols]
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    (df.repartitionByRange(files, *order, tie).sortWithinPartitions(*order)
     .write.mode("errorifexists").parquet(out_path))
    written = spark.read.schema(df.schema).parquet(out_path)
    after = fingerprint(written)
    if before != after:
        raise RuntimeError(f"compaction changed rows: {before} -> {after}")
    return written


def partition_registry(spark: SparkSession, path: str, column: str, premake: int = 0,
                       interval: str = "day") -> DataFrame:
    """(partition, row_count) of a partitioned table, with ``premake`` coming partitions listed at 0 rows.

    Only the partition column is read, so row counts come from file footers.
    """
    present = spark.read.parquet(path).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    if not premake:
        return present
    coming = (present.agg(F.max(column).alias("top"))
              .select(F.explode(F.expr(
                  f"sequence(top + interval 1 {interval}, top + interval {premake} {interval}, interval 1 {interval})"))
                  .alias(column))
              .withColumn(column, F.col(column).cast("date")).withColumn("row_count", F.lit(0).cast("long")))
    return present.unionByName(coming)


def retain(spark: SparkSession, path: str, column: str, keep: int, dry_run: bool = True) -> DataFrame:
    """Keep the newest ``keep`` partitions.  Returns (partition, row_count, dropped); directories
    go only when ``dry_run`` is off.  The registry has one row per partition directory."""
    registry = partition_registry(spark, path, column)
    newest = registry.select(column).orderBy(F.desc_nulls_last(column)).limit(keep)
    oldest_kept = newest.agg(F.min(column)).first()[0]
    if oldest_kept is None:
        return registry.withColumn("dropped", F.lit(False))
    report = registry.withColumn("dropped", F.col(column) < F.lit(oldest_kept))
    if not dry_run:
        doomed = [r[0] for r in report.where("dropped").select(F.col(column).cast("string")).toLocalIterator()]
        report = spark.createDataFrame(report.collect(), report.schema)
        jvm = spark._jvm
        for value in doomed:
            target = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        spark.catalog.refreshByPath(path)
    return report

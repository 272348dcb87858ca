"""Row sources without files: SQL text, series, inline values; samples and CSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodework.operators.ordered import HOT_ROWS, paged


def run_sql(spark: SparkSession, text: str, args: dict | None = None,
            tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """SQL text with bound parameters over the given tables, which are named in the text as {name}."""
    return spark.sql(text, args=args or {}, **(tables or {}))


def series(spark: SparkSession, lo: int, hi: int, step: int = 1, name: str = "g") -> DataFrame:
    """Integers lo..hi, both ends included; ``step`` may be negative."""
    if step == 0:
        raise ValueError("step must not be 0")
    return spark.range(lo, hi + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def time_series(bounds: DataFrame, lo: str, hi: str, every: str, name: str = "t") -> DataFrame:
    """One row per step between the columns ``lo`` and ``hi`` of each input row (both included)."""
    return bounds.select(*[c for c in bounds.columns if c not in (lo, hi)],
                         F.explode(F.expr(f"sequence({lo}, {hi}, interval {every})")).alias(name))


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline rows with a declared schema; a local relation the optimizer can fold."""
    fields = T.StructType.fromDDL(schema).fields
    binds = {f"v{i}_{j}": value for i, row in enumerate(rows) for j, value in enumerate(row)}
    tuples = ", ".join("(" + ", ".join(f":v{i}_{j}" for j in range(len(fields))) + ")" for i in range(len(rows)))
    if not rows:
        return spark.createDataFrame([], schema)
    inline = spark.sql(f"SELECT * FROM VALUES {tuples} AS v({', '.join(f'c{j}' for j in range(len(fields)))})", args=binds)
    return inline.select(*[F.col(f"c{j}").cast(f.dataType).alias(f.name) for j, f in enumerate(fields)])


def sample_rows(df: DataFrame, n: int, key: str, direct: int = 10_000) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), the same ones on every run: the lowest by md5 of the key.

    A large ``n`` never gathers in one place: counts per hash bucket fix the bucket where the
    n-th row lies; whole buckets below it are kept by a filter and only that bucket is sorted.
    """
    mixed = df.withColumn("_h", F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    lowest = [F.col("_h"), F.col(key)]
    if n <= direct:
        return mixed.orderBy(*lowest).limit(n).drop("_h")
    bucketed = mixed.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    taken = 0
    for bucket, size in sorted(bucketed.groupBy("_b").count().collect()):  # at most 65536 rows
        if taken + size >= n:
            whole = bucketed.where(F.col("_b") < bucket)
            rest = bucketed.where(F.col("_b") == bucket).orderBy(*lowest).limit(n - taken)
            return whole.unionByName(rest).drop("_h", "_b")
        taken += size
    return df


def csv_agg(df: DataFrame, group: list[str], columns: list[str], order: list[Column],
            page_rows: int = 100_000, header: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of each group as CSV text, one text per page of ``page_rows`` rows, all pages kept."""
    placed = paged(df, group, order, page_rows, hot_rows)
    line = F.to_csv(F.struct(*columns))
    texts = placed.groupBy(*group, "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_rn"), line.alias("line")))),
                                 lambda x: x["line"]), "\n").alias("csv"))
    if header:
        texts = texts.withColumn("csv", F.concat_ws("\n", F.when(F.col("page") == 0, F.lit(",".join(columns))),
                                                    F.col("csv")))
    return texts

"""Named checks on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_check(name: str, holds: Column) -> tuple[str, Column]:
    """A condition every row must meet; NULL counts as not met."""
    return name, holds


def check_rows(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(name, ok, failing): all row checks in one pass over the table."""
    counts = df.agg(*[F.count_if(~F.coalesce(holds, F.lit(False))).alias(f"_c{i}") for i, (_, holds) in enumerate(checks)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), (F.col(f"_c{i}") == 0).alias("ok"), F.col(f"_c{i}").alias("failing"))
        for i, (name, _) in enumerate(checks)])))


def check_unique(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """No key occurs twice; ``failing`` counts the keys that do."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.agg(F.count(F.lit(1)).alias("failing")).select(F.lit(name).alias("name"), (F.col("failing") == 0).alias("ok"), "failing")


def check_reference(df: DataFrame, name: str, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Every value of a column is present in the other table; NULLs are not looked up."""
    lost = df.where(F.col(column).isNotNull()).join(other.select(F.col(other_column).alias("_ref")).distinct(), F.col(column) == F.col("_ref"), "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("failing")).select(F.lit(name).alias("name"), (F.col("failing") == 0).alias("ok"), "failing")


def check_same_rows(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Both tables hold the same bag of rows: one grouped count of signed copies, no pairing of rows."""
    signed = a.select("*", F.lit(1).alias("_s")).unionByName(b.select("*", F.lit(-1).alias("_s")))
    off = signed.groupBy(*a.columns).agg(F.sum("_s").alias("d")).where("d <> 0")
    return (off.agg(F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("failing"))
            .select(F.lit(name).alias("name"), (F.col("failing") == 0).alias("ok"), "failing"))


def check_value(spark: SparkSession, name: str, got, want, equal: bool = True) -> DataFrame:
    """Two plain values are equal (or, with ``equal=False``, differ)."""
    ok = (got == want) == equal
    return spark.createDataFrame([(name, ok, 0 if ok else 1)], "name string, ok boolean, failing long")


def run_checks(parts: list[DataFrame]) -> DataFrame:
    """(number, name, ok, failing, line) of several checks, numbered by name; the table has one row per check."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("name", "ok", "failing"))).alias("c")).select(F.posexplode("c").alias("i", "c"))
    line = F.concat(F.when(F.col("c.ok"), "ok ").otherwise("not ok "), (F.col("i") + 1).cast("string"), F.lit(" - "), F.col("c.name"))
    return ordered.select((F.col("i") + 1).cast("long").alias("number"), "c.name", "c.ok", "c.failing", line.alias("line"))

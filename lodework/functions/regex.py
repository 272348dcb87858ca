"""Regular expressions over a column (Java dialect, unanchored)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regex_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows in which the pattern is found."""
    return df.where(F.col(column).rlike(pattern))


def regex_extract(df: DataFrame, column: str, pattern: str, group: int = 1, name: str = "extracted") -> DataFrame:
    """Captured group of the first match; NULL when there is none or it is empty."""
    return df.withColumn(name, F.nullif(F.regexp_extract(F.col(column), pattern, group), F.lit("")))


def regex_count(df: DataFrame, column: str, pattern: str, name: str = "matches") -> DataFrame:
    """Number of non-overlapping matches."""
    return df.withColumn(name, F.regexp_count(F.col(column), F.lit(pattern)).cast("long"))

"""Federated scans over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str | None = None, query: str | None = None,
                 partition_col: str | None = None, bounds: tuple | None = None, n: int = 1,
                 **options) -> dict[str, str]:
    """Reader options; a partitioned read needs the column and its bounds."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    chosen = {"url": url, "fetchsize": "10000", "pushDownPredicate": "true", **options}
    if query is not None:
        if partition_col is not None:
            # Spark allows no partition column beside "query": wrap the text as a derived table
            chosen["dbtable"] = f"({query}) remote_rows"
        else:
            chosen["query"] = query
    else:
        chosen["dbtable"] = table
    if partition_col is not None:
        if bounds is None:
            raise ValueError("a partitioned read needs bounds")
        chosen.update(partitionColumn=partition_col, lowerBound=str(bounds[0]),
                      upperBound=str(bounds[1]), numPartitions=str(n))
    return chosen


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, **kwargs) -> DataFrame:
    """Remote table as a DataFrame.

    Comparison filters and column pruning are pushed to the remote; send joins and aggregates
    as ``query``.  Bounds only steer the split: rows outside them are read too.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", n: int | None = None, **options) -> None:
    """Write to a remote table over at most ``n`` connections."""
    writer = df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).options(**options)
    if n is not None:
        writer = writer.option("numPartitions", str(n))
    writer.save()

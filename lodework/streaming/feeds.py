"""Change feeds: JSON records to typed rows, and replication of tables from a feed.

A record is {"pos": n, "change": [{"kind", "table", "names": [], "values": [], "key": {}}]}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.operators.tabular import all_of

RECORD = """pos BIGINT, change ARRAY<STRUCT<kind STRING, `table` STRING, names ARRAY<STRING>, `values` ARRAY<STRING>,
key MAP<STRING, STRING>>>"""


def parse_changes(feed: DataFrame, column: str = "value") -> DataFrame:
    """(pos, step, kind, table, fields, key): one row per change; a text that is no record gives no row."""
    record = feed.select(F.from_json(column, RECORD).alias("r"))
    rows = record.select("r.pos", F.posexplode("r.change").alias("step", "c"))
    fields = F.map_from_arrays(F.coalesce("c.names", F.array().cast("array<string>")), F.coalesce("c.values", F.array().cast("array<string>")))
    return rows.select("pos", "step", F.lower("c.kind").alias("kind"), F.col("c.table").alias("table"), fields.alias("fields"), "c.key")


class ReplicationSet:
    """The tables a subscriber follows, with their key columns and column types."""

    def __init__(self, tables: dict[str, tuple[list[str], str]] | None = None):
        self.tables = dict(tables or {})

    def add_table(self, name: str, keys: list[str], schema: str) -> "ReplicationSet":
        return ReplicationSet({**self.tables, name: (keys, schema)})

    def remove_table(self, name: str) -> "ReplicationSet":
        return ReplicationSet({n: t for n, t in self.tables.items() if n != name})


def _typed(schema: str, source: str) -> list[Column]:
    from pyspark.sql import types as T

    return [F.try_element_at(F.col(source), F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields]


def latest_changes(changes: DataFrame, table: str, keys: list[str], schema: str) -> DataFrame:
    """(columns, kind): the last change of each key of a table by position; combines before the shuffle.

    An update that changes the key deletes the row of the old key and sets that of the new one.
    """
    mine = changes.where(F.col("table") == table)
    rows = mine.select(*_typed(schema, "fields"), "kind", "pos", "step", "key")
    named = {k: F.try_element_at("key", F.lit(k)).try_cast(rows.schema[k].dataType) for k in keys}
    others = [c for c in rows.columns if c not in (*keys, "key", "kind")]
    moved = (F.col("kind") == "update") & ~all_of([F.coalesce(named[k] == F.col(k), F.lit(True)) for k in keys])
    new = [F.when(moved, F.col(k)).otherwise(F.coalesce(named[k], F.col(k))).alias(k) for k in keys]
    left_behind = rows.where(moved).select(*[F.coalesce(named[k], F.col(k)).alias(k) for k in keys], F.lit("delete").alias("kind"), *others)
    keyed = rows.select(*new, "kind", *others).unionByName(left_behind)
    values = [c for c in keyed.columns if c not in (*keys, "kind", "pos", "step")]
    last = keyed.groupBy(*keys).agg(F.max_by(F.struct("kind", "pos", *values), F.struct("pos", "step")).alias("_last"))
    return last.select(*keys, *[F.col("_last")[v].alias(v) for v in values], F.col("_last.kind").alias("kind"), F.col("_last.pos").alias("pos"))


def apply_feed(target: DataFrame | None, changes: DataFrame, table: str, subscribed: ReplicationSet) -> DataFrame:
    """New version of a copy after a batch of changes; a table outside the set is not touched.

    The last change per key wins, so applying the same batch again gives the same table.
    """
    if table not in subscribed.tables:
        return target
    keys, schema = subscribed.tables[table]
    last = latest_changes(changes, table, keys, schema)
    fresh = last.where("kind <> 'delete'").drop("kind", "pos")
    if target is None:
        return fresh
    touched = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    kept = target.join(touched, all_of([F.col(k) == F.col(f"_k_{k}") for k in keys]), "left_anti")
    return kept.unionByName(fresh.select(*target.columns))

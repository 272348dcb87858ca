"""Row-level rewrites, table comparison, collation and version order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.operators.ordered import null_safe


def rewrite(df: DataFrame, predicate: Column, set_: dict[str, Column] | None = None) -> DataFrame:
    """UPDATE (with ``set_``) or DELETE (without) as a new version of the table.

    Rows for which the predicate is NULL count as not matched and stay as they are.
    """
    hit = F.coalesce(predicate, F.lit(False))
    if set_ is None:
        return df.where(~hit)
    types = dict(df.dtypes)
    return df.select(*[F.when(hit, set_[c]).otherwise(F.col(c)).cast(types[c]).alias(c) if c in set_ else F.col(c)
                       for c in df.columns])


def insert_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT .. SELECT as a new version of the table; columns the rows lack become NULL."""
    return df.unionByName(rows, allowMissingColumns=True)


def upsert(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """New version of a table in which rows of ``changes`` replace rows of equal key."""
    renamed = changes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    on = null_safe(df, renamed, [(k, f"_k{i}") for i, k in enumerate(keys)])
    return df.join(renamed, on, "left_anti").unionByName(changes)


def table_diff(actual: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, changed): missing, extra or changed rows, with the names of the changed columns.

    Keys are unique on both sides.  Both sides are stacked and grouped by key, so one shuffle with
    partial aggregation replaces a full outer join.
    """
    others = [c for c in actual.columns if c not in keys]

    def side(df, flag):
        return df.select(*keys, F.struct(*others).alias("_row"), F.lit(flag).alias("_desired"))

    stacked = side(actual, False).unionByName(side(desired, True))
    both = stacked.groupBy(*keys).agg(
        F.count_if(~F.col("_desired")).alias("_in_actual"), F.count_if(F.col("_desired")).alias("_in_desired"),
        F.any_value(F.when(~F.col("_desired"), F.col("_row")), True).alias("_a"),
        F.any_value(F.when(F.col("_desired"), F.col("_row")), True).alias("_d"))
    changed = F.filter(F.array(*[F.when(~F.col("_a")[c].eqNullSafe(F.col("_d")[c]), F.lit(c)) for c in others]),
                       lambda x: x.isNotNull())
    status = (F.when(F.col("_in_actual") == 0, "missing").when(F.col("_in_desired") == 0, "extra")
              .when(F.size(changed) > 0, "changed"))
    return (both.withColumn("status", status).where(F.col("status").isNotNull())
            .select(*keys, "status", F.when(F.col("status") == "changed", F.array_join(changed, ",")).alias("changed")))


def collated(column: str | Column, collation: str = "UNICODE_CI_AI") -> Column:
    """Column under a collation, for order, grouping, equality and join keys."""
    return F.collate(F.col(column) if isinstance(column, str) else column, collation)


def semver_key(version: Column) -> Column:
    """Sortable form of ``major.minor.patch[-pre.release][+build]``.

    A release sorts above its pre-releases; identifiers of a pre-release compare one by one,
    numeric ones by value and below text; a shorter list sorts first; build text is ignored.
    """
    text = F.regexp_extract(version, r"^v?((?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?)(?:\+[0-9A-Za-z.-]+)?$", 1)
    core = [F.regexp_extract(text, rf"^(?:\d+\.){{{i}}}(\d+)", 1).cast("long") for i in range(3)]
    pre = F.regexp_extract(text, r"-(.*)$", 1)
    identifiers = F.transform(
        F.split(pre, r"\."),
        lambda x: F.struct(
            (~x.rlike(r"^\d+$")).alias("is_text"),
            F.when(x.rlike(r"^\d+$"), x.cast("decimal(38,0)")).alias("number"),
            F.when(~x.rlike(r"^\d+$"), x).alias("text")))
    return F.when(text != "", F.struct(core[0].alias("major"), core[1].alias("minor"), core[2].alias("patch"),
                                       (pre == "").alias("is_release"), identifiers.alias("pre")))


def semver_latest(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Newest version per group, with how many rows carry a valid version."""
    key = semver_key(F.col(column))
    return df.where(key.isNotNull()).groupBy(*group).agg(
        F.max_by(F.col(column), F.struct(key, F.col(column))).alias("latest"),
        F.count(F.lit(1)).alias("versions"))


def full_outer(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join as left outer join plus the unmatched right rows.

    Adaptive execution splits a skewed side of left, anti and semi joins but not of a full outer join.
    """
    matched = left.join(right, on, "left")
    lone = right.join(left.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(lone, allowMissingColumns=True)


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))

"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task works on at a time; bounds what lists of words it holds.
BLOCK_CHARS = 1 << 20


def worker_store(name: str, build: Callable[[], object]) -> object:
    """What ``build`` gave when this Python worker first asked for ``name``.

    Functions travel to the workers by value, so their module's globals do not outlive a task; this does.
    """
    kept = sys.modules.setdefault("_lodework_worker", types.ModuleType("_lodework_worker")).__dict__
    if name not in kept:
        kept[name] = build()
    return kept[name]


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` characters; a longer text is a range of its own."""
    start = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def whole_text(df: DataFrame, text_col: str) -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``_id`` and ``_text`` (null: empty) alone; other columns, whatever their names, are left behind."""
    return df.select(df[id_col].cast("bigint").alias("_id"), whole_text(df, text_col).alias("_text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

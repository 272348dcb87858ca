"""Registry of queries: name, Spark callable, independent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodework.session import Tables, apply_runtime_settings, load_tables


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[SparkSession, Tables], DataFrame]
    oracle: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_runtime_settings(spark)
        return self.build(spark, load_tables(spark, sf_dir))


PLANS: dict[str, Plan] = {}


def plan(name: str, oracle: str | None = None):
    """Register ``fn(spark, tables) -> DataFrame`` under a query name."""

    def register(fn):
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = Plan(name, fn, oracle)
        return fn

    return register

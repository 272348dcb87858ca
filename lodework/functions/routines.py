"""User functions: scalar, aggregate and table functions in Python, exchanged in Arrow batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NAN = float("nan")  # one object, so that keys with it are equal


def register_scalar(spark: SparkSession, name: str, fn: Callable, returns: str, vectorized: bool = False):
    """Scalar function for DataFrames and SQL text.

    ``vectorized`` functions take and give pandas Series; others run per row over Arrow batches.
    """
    made = F.pandas_udf(fn, returns) if vectorized else F.udf(fn, returns, useArrow=True)
    return spark.udf.register(name, made)


def register_sql(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    """Scalar function written in SQL; Catalyst inlines it, so it costs nothing at run time."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")


def register_table(spark: SparkSession, name: str, handler: type, returns: str):
    """Table function for FROM and LATERAL."""
    made = F.udtf(handler, returnType=returns)
    spark.udtf.register(name, made)
    return made


# rows a task gathers before it forms partial states, and shares of a group that meet on their own first
GATHER_ROWS, SHARES = 200_000, 16


def grouped_agg(df: DataFrame, group: list[str], columns: list[str], partial: Callable[[pd.DataFrame], object],
                merge: Callable[[list], object], finish: Callable[[object], object], returns: str, name: str = "result") -> DataFrame:
    """User aggregate that never needs a whole group in one place.

    ``partial`` turns some rows of a group into a small state, ``merge`` folds a list of states, ``finish``
    reads the result.  The rows are dealt out by group and share, sorted, so the rows of a group stand together
    and states are formed once a share or ``GATHER_ROWS`` rows, however many groups there are; the states are
    shuffled by group, sorted, and folded as they stream by, a few at a time.
    """
    keys = [df.schema[g] for g in group]
    state_schema = T.StructType([*keys, T.StructField("_state", T.BinaryType())])
    result_schema = T.StructType([*keys, T.StructField(name, T._parse_datatype_string(returns))])
    state_arrow, result_arrow = to_arrow_schema(state_schema), to_arrow_schema(result_schema)

    def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= GATHER_ROWS:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            frame = table.to_pandas()
            # keys as Python values: pandas would read whole numbers beside a null as floats
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(table.column(g).to_pylist() for g in group), strict=True)):
                places.setdefault(tuple(v if v == v else NAN for v in key), []).append(i)
            yield made([(*key, pickle.dumps(partial(frame.iloc[at]))) for key, at in places.items()], state_arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            done = []
            for *values, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(v if v == v else NAN for v in values)
                if key != current:
                    if held:
                        done.append((*current, finish(merge(held))))
                    current, held = key, []
                held.append(pickle.loads(state))
                if len(held) >= 64:
                    held = [merge(held)]
            if done:
                yield made(done, result_arrow)
        if held:
            yield made([(*current, finish(merge(held)))], result_arrow)

    rows = df.select(*group, *[c for c in columns if c not in group])
    # the rows of a task are dealt out by turns, so a group that is most of the table is no single task's
    dealt = rows.repartition(*[F.col(g) for g in group], F.pmod(F.monotonically_increasing_id(), F.lit(SHARES))).sortWithinPartitions(*group)
    states = dealt.mapInArrow(form, state_schema)
    return states.repartition(*group).sortWithinPartitions(*group).mapInArrow(fold, result_schema)

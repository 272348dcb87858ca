"""Mergeable summaries: distinct counts (HyperLogLog), quantiles (KLL and t-digest)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12  # relative standard error about 1.6 %


def hll_build(df: DataFrame, group: list[str], column: str, lg_k: int = LG_K, name: str = "sketch") -> DataFrame:
    """One sketch per group; built per task and merged, so hot groups stay small in the shuffle."""
    return df.groupBy(*group).agg(F.hll_sketch_agg(column, lg_k).alias(name))


def hll_rollup(sketches: DataFrame, group: list[str], name: str = "sketch") -> DataFrame:
    """Merge stored sketches into coarser groups."""
    return sketches.groupBy(*group).agg(F.hll_union_agg(name).alias(name))


hll_merge = hll_rollup


def hll_estimate(sketches: DataFrame, name: str = "sketch", out: str = "estimate") -> DataFrame:
    return sketches.withColumn(out, F.hll_sketch_estimate(name)).drop(name)


def hll_count(df: DataFrame, group: list[str], column: str, lg_k: int = LG_K, out: str = "estimate") -> DataFrame:
    """Approximate distinct count per group."""
    return hll_estimate(hll_build(df, group, column, lg_k), out=out)


def hll_pair_union(left: DataFrame, right: DataFrame, keys: list[str], name: str = "sketch") -> DataFrame:
    """Union of two sketch tables; a key on one side only keeps its sketch."""
    return hll_rollup(left.select(*keys, name).unionByName(right.select(*keys, name)), keys, name)


def quantiles(df: DataFrame, group: list[str], column: str, probs: list[float], accuracy: int = 10_000) -> DataFrame:
    """(group, p, quantile) with rank error below 1 / accuracy."""
    ests = df.groupBy(*group).agg(F.percentile_approx(column, probs, accuracy).alias("_q"))
    return ests.select(*group, F.posexplode("_q").alias("_i", "quantile")).select(
        *group, F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1).alias("p"), "quantile")


def quantile_build(df: DataFrame, group: list[str], column: str, k: int = 400, name: str = "sketch") -> DataFrame:
    """Storable quantile sketch per group."""
    return df.groupBy(*group).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), k).alias(name))


def quantile_rollup(sketches: DataFrame, group: list[str], name: str = "sketch") -> DataFrame:
    return sketches.groupBy(*group).agg(F.kll_merge_agg_double(name).alias(name))


def quantile_read(sketches: DataFrame, probs: list[float], name: str = "sketch") -> DataFrame:
    """(.., p, quantile) read from quantile sketches."""
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double(name, F.lit(float(p))).alias("quantile"))
                      for p in probs])
    return sketches.select(*[c for c in sketches.columns if c != name], F.inline(pairs))


#: About how many centroids a t-digest has, rows a task gathers before it compresses them, and the first merge's width.
DELTA, GATHERED, FANS = 200, 1 << 18, 256
#: Columns of a t-digest.
DIGEST = ("means", "weights", "low", "high")
DIGEST_TYPE = "means array<double>, weights array<double>, low double, high double"


def compress(means: np.ndarray, weights: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of weighted values: neighbours whose ranks share a step of the arcsine scale are one.

    The steps are narrow at both ends, so extreme values keep centroids of their own.
    """
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    middle = (np.cumsum(weights) - weights / 2) / total
    step = np.floor(delta * (np.arcsin(2 * middle - 1) / np.pi + 0.5))
    at = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
    sums = np.add.reduceat(weights, at)
    return np.add.reduceat(means * weights, at) / sums, sums


def _merged(table: pa.Table, keys: list[str], delta: int) -> pa.Table:
    """One digest per key of a table of digests."""
    numbered = table.select(keys).append_column("_row", pa.array(np.arange(len(table))))
    grouped = numbered.group_by(keys).aggregate([("_row", "list")])
    members = grouped["_row_list"].combine_chunks()
    rows, first = members.flatten().to_numpy(), members.offsets.to_numpy()[:-1]
    sizes = pc.list_value_length(table["means"].combine_chunks()).to_numpy(zero_copy_only=False)
    starts, own = np.cumsum(sizes) - sizes, sizes[rows]
    at = np.repeat(starts[rows], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    mean, weight = (table[name].combine_chunks().flatten().to_numpy()[at] for name in ("means", "weights"))
    cuts = np.append(0, np.cumsum(np.add.reduceat(own, first)))
    pairs = [compress(mean[a:b], weight[a:b], delta) for a, b in zip(cuts, cuts[1:])]
    out = {"means": [m for m, _ in pairs], "weights": [w for _, w in pairs],
           "low": np.minimum.reduceat(table["low"].to_numpy()[rows], first), "high": np.maximum.reduceat(table["high"].to_numpy()[rows], first)}
    return pa.table({**{k: grouped[k] for k in keys}, "means": pa.array(out["means"], pa.list_(pa.float64())), "weights": pa.array(out["weights"], pa.list_(pa.float64())),
                     "low": pa.array(out["low"], pa.float64()), "high": pa.array(out["high"], pa.float64())})


def _plain(kind: pa.DataType) -> pa.DataType:
    """A type as ``_merged`` gives it."""
    return pa.list_(kind.value_type) if pa.types.is_list(kind) else kind


def _combined(rows: DataFrame, keys: list[str], schema: str, delta: int) -> DataFrame:
    """Digests merged within each task; what leaves it is one digest per key and ``GATHERED`` centroids."""

    def run(batches):
        held, size = [], 0

        def merge():
            return _merged(pa.Table.from_batches(held).combine_chunks(), keys, delta).select([*keys, *DIGEST])

        for batch in batches:
            if batch.num_rows:
                # Spark's lists and merged ones name their elements differently
                held.append(pa.RecordBatch.from_arrays([c.cast(_plain(c.type)) for c in batch.columns], batch.schema.names))
                size += len(batch.column(len(keys)).flatten())
                if size > GATHERED:
                    held = merge().combine_chunks().to_batches()
                    size = sum(len(b.column(len(keys)).flatten()) for b in held)
                    if size > GATHERED // 2:  # many keys: let them go
                        yield from held
                        held, size = [], 0
        if held:
            yield from merge().to_batches()

    return rows.mapInArrow(run, schema)


def _digest_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [DIGEST_TYPE])


def tdigest_build(df: DataFrame, group: list[str], column: str, delta: int = DELTA) -> DataFrame:
    """(group, means, weights, low, high): a t-digest of the non-NULL numbers of each group."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*group, F.array(x).alias("means"), F.array(F.lit(1.0)).alias("weights"), x.alias("low"), x.alias("high"))
    return tdigest_rollup(rows, group, delta)


def tdigest_rollup(digests: DataFrame, group: list[str], delta: int = DELTA) -> DataFrame:
    """Digests merged into coarser groups: within tasks, then in ``FANS`` shares of a group, then per group, so that no
    task holds the digests of all tasks."""
    rows = digests.select(*group, *DIGEST)
    schema, names = _digest_schema(rows, group), [*group, "_fan"]
    for fans in (FANS, 1):
        rows = _combined(rows, group, schema, delta).withColumn("_fan", F.pmod(F.spark_partition_id(), F.lit(fans)))
        rows = rows.groupBy(*names).applyInArrow(lambda table: _merged(table, names, delta), _digest_schema(rows, names)).drop("_fan")
    return rows


def tdigest_read(digests: DataFrame, probs: list[float], ranks_of: list[float] | None = None) -> DataFrame:
    """(.., p, quantile) of digests or, for values in ``ranks_of``, (.., value, rank): the share of numbers below."""
    asked = list(map(float, ranks_of if ranks_of is not None else probs))

    @F.pandas_udf("array<double>")
    def read(means: pd.Series, weights: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = []
        for m, w, a, b in zip(means, weights, low, high):
            middle = (np.cumsum(w) - w / 2) / w.sum()
            # a centroid of one number is that number; the ends are known exactly
            xs, ys = np.concatenate([[0.0], middle, [1.0]]), np.concatenate([[a], m, [b]])
            out.append(np.interp(asked, xs, ys) if ranks_of is None else np.interp(asked, ys, xs))
        return pd.Series(out)

    names = ("p", "quantile") if ranks_of is None else ("value", "rank")
    found = digests.withColumn("_found", read(*DIGEST)).drop(*DIGEST)
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in asked]).alias(names[0]), F.col("_found").alias(names[1]))
    return found.select(*[c for c in found.columns if c != "_found"], F.inline(pairs).alias(*names))

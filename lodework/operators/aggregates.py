"""Group aggregates beyond the built-in ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.operators.ordered import HOT_ROWS, paged

WIDE = "decimal(38,0)"


def first_last(df: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    """first / last value per group in an explicit order; ties fall to the lower / higher value."""
    key = F.struct(*[F.col(c) for c in order], F.col(value))
    return df.groupBy(*group).agg(F.min_by(F.col(value), key).alias("first"), F.max_by(F.col(value), key).alias("last"))


def ordered_array(df: DataFrame, group: list[str], value: str, order: list[Column], page_rows: int = 100_000,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, page, values): values of a group in order.

    Groups up to ``page_rows`` rows give one array; larger ones continue on further pages, so that
    no task holds an unbounded group and no value is lost.
    """
    placed = paged(df, group, order, page_rows, hot_rows)
    return placed.groupBy(*group, "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("_rn"), F.col(value).alias("v")))),
                    lambda x: x["v"]).alias("values"))


def bucketed_histogram(df: DataFrame, ts: str, every: str, value: str, edges: tuple[float, float, int]) -> DataFrame:
    """(bucket_start, bin, rows): counts of ``value`` per time bucket and equal-width bin.

    Bins 1..n lie between the edges, 0 and n + 1 hold what is below and above; all bins of all time
    buckets from first to last are present.
    """
    lo, hi, n = edges
    start = F.window(F.col(ts), every).start
    counts = (df.select(start.alias("bucket_start"), F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(n)).alias("bin"))
              .groupBy("bucket_start", "bin").agg(F.count(F.lit(1)).alias("rows")))
    spine = (counts.agg(F.min("bucket_start").alias("lo"), F.max("bucket_start").alias("hi"))
             .select(F.explode(F.expr(f"sequence(lo, hi, interval {every})")).alias("bucket_start"))
             .select("bucket_start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n + 1).cast("long"))).alias("bin")))
    return (spine.join(counts, ["bucket_start", "bin"], "left")
            .select("bucket_start", "bin", F.coalesce("rows", F.lit(0)).alias("rows")))


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of wide integers; Euclid needs at most five steps per digit of the smaller one."""
    start = F.struct(F.abs(a).cast(WIDE).alias("a"), F.abs(b).cast(WIDE).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(
        F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast(WIDE))).cast(WIDE).alias("b")))
    digits = F.least(F.length(F.abs(a).cast(WIDE).cast("string")), F.length(F.abs(b).cast(WIDE).cast("string")))
    return F.aggregate(F.sequence(F.lit(1), 5 * digits + 2), start, step, lambda s: s["a"])


def _exact_div(a: Column, b: Column) -> Column:
    return (a / b).cast(WIDE)


def _times(a: Column, b: Column) -> Column:
    """Wide product; a result beyond 38 digits raises instead of turning NULL."""
    product = (a * b).cast(WIDE)
    lost = product.isNull() & a.isNotNull() & b.isNotNull()
    return F.when(lost, F.raise_error(F.lit("fraction overflow")).cast(WIDE)).otherwise(product)


def _add(x: Column, y: Column) -> Column:
    """Sum of two fractions over the least common denominator."""
    common = _gcd(x["den"], y["den"])
    xs, ys = _exact_div(y["den"], common), _exact_div(x["den"], common)
    return F.struct((_times(x["num"], xs) + _times(y["num"], ys)).cast(WIDE).alias("num"),
                    _times(x["den"], xs).alias("den"))


def reduced(num: Column, den: Column) -> Column:
    """Fraction in lowest terms with a positive denominator; a zero denominator raises."""
    den = F.when(den == 0, F.raise_error(F.lit("zero denominator")).cast(WIDE)).otherwise(den.cast(WIDE))
    num = F.when(den < 0, -num.cast(WIDE)).otherwise(num.cast(WIDE))
    g = _gcd(num, den)
    return F.struct(_exact_div(num, g).alias("num"), _exact_div(F.abs(den), g).alias("den"))


def fraction_less(a: Column, b: Column) -> Column:
    """Order of two fractions with positive denominators by cross-multiplication."""
    return _times(a["num"], b["den"]) < _times(b["num"], a["den"])


def fraction_sum(df: DataFrame, group: list[str], num: str, den: str, spread: int = 64) -> DataFrame:
    """Exact sum of fractions per group in lowest terms.

    Numerators are added per denominator first, so the fold sees one entry per distinct denominator.
    Those fold in ``spread`` parts and then into one, which bounds what a task holds of a group:
    all denominators must divide a number of at most 38 digits, or the sum raises.
    """
    def fold(items):
        return F.aggregate(items, F.struct(F.lit(0).cast(WIDE).alias("num"), F.lit(1).cast(WIDE).alias("den")), _add)

    def item(n, d):
        return F.struct(n.cast(WIDE).alias("num"), d.cast(WIDE).alias("den"))

    by_den = (df.where(F.col(num).isNotNull() & F.col(den).isNotNull()).groupBy(*group, den)
              .agg(F.sum(F.col(num).cast("decimal(28,0)")).alias("_n"))
              .withColumn("_f", reduced(F.col("_n"), F.col(den))))
    part = F.pmod(F.xxhash64("_f.den"), F.lit(spread))
    parts = (by_den.groupBy(*group, part.alias("_part")).agg(fold(F.collect_list(item(F.col("_f.num"), F.col("_f.den")))).alias("_f")))
    total = parts.groupBy(*group).agg(fold(F.collect_list(item(F.col("_f.num"), F.col("_f.den")))).alias("_f"))
    return (total.withColumn("_f", reduced(F.col("_f.num"), F.col("_f.den")))
            .select(*group, F.col("_f.num").alias("num"), F.col("_f.den").alias("den")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)

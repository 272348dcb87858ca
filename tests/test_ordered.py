"""Split windows give what native windows give, with a hot key, NULL keys, ties and tiny chunks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodework.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    """2000 rows; key 0 holds about half, some keys are NULL, values have gaps."""
    return spark.createDataFrame(
        [(None if n % 2 and n % 97 == 1 else (0 if n % 2 == 0 else n % 23), (n * 7919) % 509, n, (n * 31) % 40,
          None if n % 3 == 0 else (n * 7919) % 101) for n in range(2000)], "k long, t long, n long, d long, x long")



def by_time():
    return [F.asc("t"), F.asc("n")]


HOT = 60


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left, right = (sorted(map(str, d.select(*columns).collect())) for d in (a, b))
    assert left == right
    assert left


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(rows, keys, inclusive):
    frame = Window.partitionBy(*keys).orderBy(*by_time()).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    x = F.col("x")
    outputs = {"s": ("sum", x), "c": ("count", x), "lo": ("min", x), "hi": ("max", x), "last": ("last", x), "first": ("first", x)}
    native = rows.select("*", F.sum(x).over(frame).alias("s"), F.count(x).over(frame).alias("c"), F.min(x).over(frame).alias("lo"),
                         F.max(x).over(frame).alias("hi"), F.last(x, True).over(frame).alias("last"),
                         F.first(x, True).over(frame).alias("first"))
    same(ordered.running(rows, keys, by_time(), outputs, inclusive, hot_rows=HOT), native)


@pytest.mark.parametrize("descending", [False, True])
def test_numbered(rows, descending):
    order = [F.desc("t") if descending else F.asc("t"), F.asc("n")]
    w = Window.partitionBy("k").orderBy(*order)
    native = rows.select("*", F.row_number().over(w).cast("long").alias("rn"), F.ntile(7).over(w).cast("long").alias("tile"))
    same(ordered.numbered(rows, ["k"], order, "rn", ntile=("tile", 7), hot_rows=HOT), native)


def test_ranks_with_ties(rows):
    w = Window.partitionBy("k").orderBy(F.asc("d"))
    native = rows.select("*", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"))
    same(ordered.numbered(rows, ["k"], [F.asc("d")], None, rank="rk", dense_rank="dr", hot_rows=HOT), native)


def test_framed(rows):
    def build(w):
        return {"prev": F.lag("x").over(w), "next2": F.lead("x", 2).over(w), "near": F.sum("x").over(w.rowsBetween(-3, 2))}

    w = Window.partitionBy("k").orderBy(*by_time())
    native = rows.select("*", *[c.alias(n) for n, c in build(w).items()])
    same(ordered.framed(rows, ["k"], by_time(), build, preceding=3, following=2, hot_rows=HOT), native)


def test_range_framed(rows):
    def build(w):
        return {"n_near": F.count(F.lit(1)).over(w.rangeBetween(-20, 5)), "s": F.sum("x").over(w.rangeBetween(-20, 5))}

    w = Window.partitionBy("k").orderBy(F.asc("t"))
    native = rows.select("*", *[c.alias(n) for n, c in build(w).items()])
    same(ordered.range_framed(rows, ["k"], "t", build, preceding=20, following=5, hot_rows=HOT), native)


def test_hot_rows_are_cut(rows):
    cold, hot = ordered.split_hot(rows, ["k"], by_time(), HOT)
    assert cold.count() + hot.count() == rows.count()
    sizes = [r[1] for r in hot.groupBy("_chunk").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 5 * HOT


def test_pages_cover_everything(rows):
    paged = ordered.paged(rows, ["k"], by_time(), 10, hot_rows=HOT)
    sizes = paged.groupBy("k", "page").count()
    assert sizes.agg(F.max("count")).first()[0] == 10
    assert sizes.agg(F.sum("count")).first()[0] == rows.count()

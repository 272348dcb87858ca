"""Queries over user functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodework.functions.routines import grouped_agg, register_scalar, register_sql, register_table
from lodework.plans.registry import plan


@plan("udf_scalar", """
SELECT o_orderkey, o_orderkey + o_custkey AS added, 'Hello ' || o_orderstatus AS greeting, round(o_totalprice * 1.2, 2) AS gross,
       o_custkey % 3 AS in_sql FROM orders
""")
def udf_scalar(spark, t):
    add = register_scalar(spark, "py_add", lambda a, b: a + b, "bigint")
    greet = register_scalar(spark, "py_greet", lambda s: f"Hello {s}", "string")
    register_scalar(spark, "py_gross", lambda v: v * 1.2, "double", vectorized=True)
    register_sql(spark, "third_of", "x BIGINT", "BIGINT", "x % 3")
    return t.orders.select("o_orderkey", add("o_orderkey", "o_custkey").alias("added"), greet("o_orderstatus").alias("greeting"),
                           F.round(F.expr("py_gross(o_totalprice)"), 2).alias("gross"), F.expr("third_of(o_custkey)").alias("in_sql"))


@plan("udaf_grouped", """
SELECT l_suppkey, round(sqrt(avg(l_quantity * l_quantity)), 6) AS root_mean_square FROM lineitem GROUP BY 1
""")
def udaf_grouped(spark, t):
    result = grouped_agg(t.lineitem, ["l_suppkey"], ["l_quantity"],
                         partial=lambda rows: (len(rows), float(np.square(rows["l_quantity"]).sum())),
                         merge=lambda states: tuple(map(sum, zip(*states))),
                         finish=lambda s: (s[1] / s[0]) ** 0.5, returns="double", name="root_mean_square")
    return result.withColumn("root_mean_square", F.round("root_mean_square", 6))


class PriceSteps:
    """Price in thousands, split into whole hundreds and the rest."""

    def eval(self, key: int, price: float):
        whole = int(price // 100000)
        yield key, "hundred thousands", whole
        yield key, "rest", int(price) - whole * 100000


@plan("udtf_rows", """
SELECT o_orderkey AS order_key, 'hundred thousands' AS part, CAST(floor(o_totalprice / 100000) AS BIGINT) AS amount FROM orders
UNION ALL SELECT o_orderkey, 'rest', CAST(floor(o_totalprice) - floor(o_totalprice / 100000) * 100000 AS BIGINT) FROM orders
""")
def udtf_rows(spark, t):
    register_table(spark, "price_steps", PriceSteps, "order_key bigint, part string, amount bigint")
    return spark.sql("SELECT s.* FROM {orders} o, LATERAL price_steps(o.o_orderkey, o.o_totalprice) s", orders=t.orders)


class Sittings:
    """Of rows in time order, how many runs without a gap of more than an hour; keeps two numbers, not the rows."""

    def __init__(self):
        self.user, self.last, self.count = None, None, 0

    def eval(self, row):
        if self.last is None or (row["ts"] - self.last).total_seconds() > 3600:
            self.count += 1
        self.user, self.last = row["user_id"], row["ts"]

    def terminate(self):
        yield self.user, self.count


@plan("udtf_table", """
WITH g AS (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, count(*) FILTER (WHERE gap IS NULL OR gap > INTERVAL 1 HOUR) AS sittings FROM g GROUP BY 1
""")
def udtf_table(spark, t):
    register_table(spark, "sittings", Sittings, "user_id bigint, sittings bigint")
    return spark.sql("SELECT * FROM sittings(TABLE(SELECT user_id, ts FROM {events}) PARTITION BY user_id ORDER BY ts)", events=t.events)

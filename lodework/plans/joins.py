"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.operators.joins import asof_join, hinted_join
from lodework.operators.ranges import band_join, cidr_bounds, cidr_join, interval_join, ipv6_join, ipv6_range_join, network_overlap_join, prefix_join
from lodework.operators.tabular import full_outer
from lodework.plans.registry import plan
from lodework.session import stage


@plan("join_inner", """
SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 100000
""")
def join_inner(spark, t):
    return (t.orders.where("o_totalprice > 100000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name"))


@plan("join_outer", """
WITH o AS (SELECT o_custkey + 300 AS k, count(*) AS orders FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, c_name AS name FROM customer)
SELECT 'left' AS kind, c.k, name, orders FROM c LEFT JOIN o ON c.k = o.k
UNION ALL SELECT 'right', o.k, name, orders FROM c RIGHT JOIN o ON c.k = o.k
UNION ALL SELECT 'full', coalesce(c.k, o.k), name, orders FROM c FULL JOIN o ON c.k = o.k
""")
def join_outer(spark, t):
    # counted once for all joins, which are planned by its real size
    o = stage(t.orders.groupBy((F.col("o_custkey") + 300).alias("k")).agg(F.count(F.lit(1)).alias("orders")), "orders-per-customer")
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    kinds = {"left": c.join(o, "k", "left"), "right": c.join(o, "k", "right"), "full": full_outer(c, o, ["k"])}
    out = None
    for kind, df in kinds.items():
        df = df.select(F.lit(kind).alias("kind"), "k", "name", "orders")
        out = df if out is None else out.unionByName(df)
    return out


@plan("join_semi_anti", """
SELECT 'with' AS kind, c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
UNION ALL
SELECT 'without', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
""")
def join_semi_anti(spark, t):
    big = t.orders.where("o_totalprice > 450000")
    on = F.col("c_custkey") == F.col("o_custkey")
    return (t.customer.join(big, on, "left_semi").select(F.lit("with").alias("kind"), "c_custkey")
            .unionByName(t.customer.join(big, on, "left_anti").select(F.lit("without").alias("kind"), "c_custkey")))


@plan("join_lateral", """
SELECT event_id, v, CAST(r.k * v AS BIGINT) AS scaled
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) r, LATERAL (SELECT unnest(generate_series(1, 1 + r.k % 3)) AS v) l
""")
def join_lateral(spark, t):
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return spark.sql("""SELECT event_id, v, k * v AS scaled
                        FROM {rows} r, LATERAL explode(sequence(1L, 1L + r.k % 3)) AS l(v)""", rows=rows)


@plan("join_theta", """
SELECT s_suppkey, count(o_orderkey) AS orders, min(o_totalprice) AS lowest, max(o_totalprice) AS highest
FROM supplier JOIN orders ON o_totalprice >= round(s_acctbal * 40, 2) AND o_totalprice < round(s_acctbal * 40, 2) + 2000 GROUP BY s_suppkey
""")
def join_theta(spark, t):
    low = F.round(F.col("s_acctbal") * 40, 2)
    pairs = band_join(t.orders.select("o_orderkey", "o_totalprice"), t.supplier.select("s_suppkey", "s_acctbal"),
                      "o_totalprice", low, low + 2000, scale=2)
    return pairs.groupBy("s_suppkey").agg(F.count("o_orderkey").alias("orders"), F.min("o_totalprice").alias("lowest"),
                                          F.max("o_totalprice").alias("highest"))


@plan("join_hints", """
SELECT v.s AS strategy, n_name, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('broadcast'), ('merge'), ('shuffle_hash'), ('off')) v(s) GROUP BY 1, 2
""")
def join_hints(spark, t):
    out = None
    for strategy in ("broadcast", "merge", "shuffle_hash", None):
        df = (hinted_join(t.customer, t.nation, F.col("c_nationkey") == F.col("n_nationkey"), strategy)
              .groupBy(F.lit(strategy or "off").alias("strategy"), "n_name")
              .agg(F.count(F.lit(1)).alias("customers"),
                   F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance")))
        out = df if out is None else out.unionByName(df)
    return out


@plan("join_cidr", """
WITH a AS (SELECT event_id, 167772160 + (user_id * 2654435761) % 16777216 AS ip FROM events),
n AS (SELECT s_suppkey, 167772160 + (s_suppkey % 256) * 65536 AS lo,
             167772160 + (s_suppkey % 256) * 65536 + CASE WHEN s_suppkey % 2 = 1 THEN 32767 ELSE 65535 END AS hi FROM supplier)
SELECT event_id, ip, s_suppkey FROM a JOIN n ON ip BETWEEN lo AND hi
""")
def join_cidr(spark, t):
    a = t.events.select("event_id", (F.lit(167772160) + (F.col("user_id") * F.lit(2654435761)) % 16777216).alias("ip"))
    lo = F.lit(167772160).cast("long") + (F.col("s_suppkey") % 256) * 65536
    n = t.supplier.select("s_suppkey", lo.alias("lo"), (lo + F.when(F.col("s_suppkey") % 2 == 1, 32767).otherwise(65535)).alias("hi"))
    return cidr_join(a, n).select("event_id", "ip", "s_suppkey")


@plan("join_network_overlap", """
WITH s AS (SELECT s_suppkey, (s_suppkey % 200) * 65536 AS lo, CASE WHEN s_suppkey % 3 = 0 THEN 131072 ELSE 16384 END AS size FROM supplier),
b AS (SELECT s_suppkey, 167772160 + lo // size * size AS lo, 167772160 + lo // size * size + size - 1 AS hi FROM s)
SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM b x JOIN b y ON x.lo <= y.hi AND y.lo <= x.hi
""")
def join_network_overlap(spark, t):
    key = F.col("s_suppkey") % 200
    text = F.concat(F.lit("10."), key.cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".0.0/15").otherwise(".0.0/18"))
    nets = t.supplier.select("s_suppkey", cidr_bounds(text).alias("n"))
    a = nets.select(F.col("s_suppkey").alias("a"), F.col("n.lo").alias("a_lo"), F.col("n.hi").alias("a_hi"))
    b = nets.select(F.col("s_suppkey").alias("b"), F.col("n.lo").alias("b_lo"), F.col("n.hi").alias("b_hi"))
    return network_overlap_join(a, b, "a_lo", "a_hi", "b_lo", "b_hi").select("a", "b")


@plan("join_ipv6", """
WITH a AS (SELECT event_id, user_id * 7919 % 65536 AS g FROM events),
n AS (SELECT s_suppkey, s_suppkey * 7919 % 65536 AS g, s_suppkey % 2 AS odd FROM supplier)
SELECT event_id, s_suppkey FROM a JOIN n ON CASE WHEN odd = 1 THEN a.g // 16 = n.g // 16 ELSE a.g = n.g END
""")
def join_ipv6(spark, t):
    group = lambda key: F.lower(F.hex(F.col(key).cast("long") * 7919 % 65536))
    a = t.events.select("event_id", F.concat(F.lit("2001:db8:"), group("user_id"), F.lit("::"), F.lower(F.hex(F.col("event_id") % 65536))).alias("ip"))
    n = t.supplier.select("s_suppkey", F.concat(F.lit("2001:db8:"), group("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 1, "::/44").otherwise("::/48")).alias("net"))
    return ipv6_join(a, n, "ip", "net").select("event_id", "s_suppkey")


@plan("join_ipv6_ranges", """
WITH a AS (SELECT event_id, user_id * 7919 % 65536 AS g, event_id % 65536 AS tail FROM events),
n AS (SELECT s_suppkey, s_suppkey * 7919 % 65536 AS g, s_suppkey * 31 % 4096 AS d, s_suppkey % 7 AS w FROM supplier)
SELECT event_id, s_suppkey FROM a JOIN n ON (a.g > n.g OR (a.g = n.g AND tail >= d)) AND (a.g < n.g + w OR (a.g = n.g + w AND tail <= d + 5000)) AND n.g + w < 65536
""")
def join_ipv6_ranges(spark, t):
    """Spans that start and end anywhere, over several networks."""
    text = lambda g, tail: F.concat(F.lit("2001:db8:"), F.lower(F.hex(g)), F.lit("::"), F.lower(F.hex(tail)))
    a = t.events.select("event_id", text(F.col("user_id").cast("long") * 7919 % 65536, F.col("event_id") % 65536).alias("ip"))
    key = F.col("s_suppkey").cast("long")
    g, d, w = key * 7919 % 65536, key * 31 % 4096, key % 7
    n = t.supplier.where(g + w < 65536).select("s_suppkey", text(g, d).alias("from"), text(g + w, d + 5000).alias("to"))
    return ipv6_range_join(a, n, "ip", "from", "to").select("event_id", "s_suppkey")


PHONE = "lpad(CAST(c_custkey * 7919 % 10000000000 AS string), 10, '0')"


@plan("join_longest_prefix", """
WITH n AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '0') AS phone FROM customer),
p AS (SELECT DISTINCT left(phone, 5 + (c_custkey % 5)::INT) AS prefix FROM n),
m AS (SELECT c_custkey, phone, prefix, row_number() OVER (PARTITION BY c_custkey ORDER BY length(prefix) DESC) AS rn
      FROM n JOIN p ON starts_with(phone, prefix))
SELECT c_custkey, phone, prefix FROM m WHERE rn = 1
""")
def join_longest_prefix(spark, t):
    numbers = t.customer.select("c_custkey", F.expr(PHONE).alias("phone"))
    routes = numbers.select(F.expr("left(phone, CAST(5 + c_custkey % 5 AS INT))").alias("prefix")).distinct()
    return prefix_join(numbers, routes, "phone", "prefix").select("c_custkey", "phone", "prefix")


@plan("join_overlap", """
WITH p AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(o_orderdate AS DATE) AS f,
                  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 + 1 AS INTEGER) AS u FROM orders)
SELECT a.id AS left_id, b.id AS right_id, greatest(a.f, b.f) AS shared_from, least(a.u, b.u) AS shared_to
FROM p a JOIN p b ON a.k = b.k AND a.id < b.id AND a.f < b.u AND b.f < a.u
""")
def join_overlap(spark, t):
    p = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"),
                        F.col("o_orderdate").cast("date").alias("f"),
                        F.expr("date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 90 + 1 AS INT))").alias("u"))
    left = p.toDF("k", "left_id", "lf", "lu")
    right = p.toDF("k", "right_id", "rf", "ru")
    return (interval_join(left, right, "lf", "lu", "rf", "ru", ["k"]).where("left_id < right_id")
            .select("left_id", "right_id", F.greatest("lf", "rf").alias("shared_from"), F.least("lu", "ru").alias("shared_to")))


@plan("join_asof", """
WITH v AS (SELECT user_id, ts, event_type AS state, event_id AS version_id FROM events WHERE event_type IN ('signup', 'purchase')),
l AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type NOT IN ('signup', 'purchase'))
SELECT l.event_id, l.user_id, l.ts, l.value, v.state, v.version_id FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.ts
""")
def join_asof(spark, t):
    changes = t.events.where("event_type IN ('signup', 'purchase')").select(
        "user_id", "ts", F.col("event_type").alias("state"), F.col("event_id").alias("version_id"))
    rows = t.events.where("event_type NOT IN ('signup', 'purchase')").select("user_id", "ts", "event_id", "value")
    return asof_join(rows, changes, ["user_id"], "ts", ["event_id"], ["state", "version_id"])

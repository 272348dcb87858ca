"""Queries over graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.operators import graph
from lodework.plans.registry import plan
from lodework.session import scratch_path


def world(t):
    """Customers, nations and regions; who lives where; which nation is part of which region."""
    vertices = (graph.create_vertices(t.customer, "Customer", ["c_custkey"], ["c_mktsegment", "c_acctbal"])
                .unionByName(graph.create_vertices(t.nation, "Nation", ["n_nationkey"], ["n_name"]))
                .unionByName(graph.create_vertices(t.region, "Region", ["r_regionkey"], ["r_name"])))
    edges = (graph.create_edges(t.customer, "LIVES_IN", graph.vertex_id("Customer", "c_custkey"), graph.vertex_id("Nation", "c_nationkey"))
             .unionByName(graph.create_edges(t.nation, "PART_OF", graph.vertex_id("Nation", "n_nationkey"),
                                             graph.vertex_id("Region", "n_regionkey"))))
    return vertices, edges


@plan("graph_match", """
SELECT r_name AS region, n_name AS nation, count(*) AS customers
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 GROUP BY 1, 2
""")
def graph_match(spark, t):
    vertices, edges = world(t)
    rows = graph.match(vertices, edges, [
        {"label": "Customer", "where": [("$.c_mktsegment", "=", "BUILDING"), ("$.c_acctbal", ">=", 1000)]},
        {"type": "LIVES_IN"}, {"label": "Nation"}, {"type": "PART_OF"}, {"label": "Region"}])
    return rows.groupBy(F.variant_get("n2_props", "$.r_name", "string").alias("region"),
                        F.variant_get("n1_props", "$.n_name", "string").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))


@plan("graph_create", """
SELECT 'vertex' AS kind, 'Customer' AS name, count(*) AS n, count(DISTINCT c_custkey) AS ids FROM customer
UNION ALL SELECT 'vertex', 'Nation', count(*), count(DISTINCT n_nationkey) FROM nation
UNION ALL SELECT 'vertex', 'Region', count(*), count(DISTINCT r_regionkey) FROM region
UNION ALL SELECT 'edge', 'LIVES_IN', count(*), count(DISTINCT c_custkey) FROM customer
UNION ALL SELECT 'edge', 'PART_OF', count(*), count(DISTINCT n_nationkey) FROM nation
""")
def graph_create(spark, t):
    path = scratch_path(spark, "graph")
    graph.save_graph(*world(t), path)
    vertices, edges = graph.load_graph(spark, path)
    return (vertices.groupBy(F.lit("vertex").alias("kind"), F.col("label").alias("name"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))
            .unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name"))
                         .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("ids"))))


TRADE_SQL = """
e AS (SELECT DISTINCT 'Region:' || n_regionkey AS src, 'Nation:' || n_nationkey AS dst FROM nation
      UNION SELECT 'Nation:' || n_nationkey, 'Region:' || n_regionkey FROM nation
      UNION SELECT 'Nation:' || s_nationkey, 'Supplier:' || s_suppkey FROM supplier
      UNION SELECT 'Supplier:' || l_suppkey, 'Part:' || l_partkey FROM lineitem)
"""


@plan("graph_varlen", f"""
WITH RECURSIVE {TRADE_SQL},
w AS (SELECT 'Region:' || r_regionkey AS origin, 'Region:' || r_regionkey AS id, 0::BIGINT AS hops FROM region
      UNION SELECT origin, e.dst, hops + 1 FROM w JOIN e ON w.id = e.src WHERE hops < 3)
SELECT origin, id, min(hops) AS hops FROM w GROUP BY 1, 2
""")
def graph_varlen(spark, t):
    vid = graph.vertex_id
    edges = t.nation.select(vid("Region", "n_regionkey").alias("src"), vid("Nation", "n_nationkey").alias("dst"))
    edges = (edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
             .unionByName(t.supplier.select(vid("Nation", "s_nationkey").alias("src"), vid("Supplier", "s_suppkey").alias("dst")))
             .unionByName(t.lineitem.select(vid("Supplier", "l_suppkey").alias("src"), vid("Part", "l_partkey").alias("dst"))))
    return graph.reach(edges, t.region.select(vid("Region", "r_regionkey").alias("id")), 3)


def trade_lanes(t):
    """Nation to nation, at most five apart in number; the cost is how many lines went that way."""
    lines = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(t.customer, F.col("o_custkey") == F.col("c_custkey")))
    return (lines.where(F.abs(F.col("s_nationkey") - F.col("c_nationkey")).between(1, 5))
            .groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target"))
            .agg(F.count(F.lit(1)).cast("double").alias("cost")))


def _bellman(rounds: int) -> str:
    """SQL rounds of relaxation, one common table each."""
    parts = ["d0 AS MATERIALIZED (SELECT 0 AS node, {'cost': 0.0::DOUBLE, 'hops': 0, 'prev': NULL::INTEGER} AS b)"]
    for i in range(1, rounds + 1):
        parts.append(f"""d{i} AS MATERIALIZED (SELECT node, min(b) AS b FROM (SELECT node, b FROM d{i - 1} UNION ALL
          SELECT target, {{'cost': b.cost + cost, 'hops': b.hops + 1, 'prev': node}} FROM d{i - 1} JOIN e ON source = node) GROUP BY node)""")
    return ",\n".join(parts)


@plan("shortest_path", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT s_nationkey AS source, c_nationkey AS target, count(*)::DOUBLE AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
   JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE abs(s_nationkey - c_nationkey) BETWEEN 1 AND 5 GROUP BY 1, 2),
{_bellman(24)},
p AS (SELECT node, b.cost AS agg_cost, b.hops AS hops, b.prev AS prev FROM d24 WHERE node = 24
      UNION ALL SELECT d24.node, d24.b.cost, d24.b.hops, d24.b.prev FROM d24 JOIN p ON d24.node = p.prev)
SELECT CAST(hops + 1 AS BIGINT) AS seq, node, coalesce(lead(agg_cost) OVER (ORDER BY hops), agg_cost) - agg_cost AS cost, agg_cost FROM p
""")
def shortest_path(spark, t):
    return graph.dijkstra(trade_lanes(t), 0, 24)


@plan("shortest_path_pairs", f"""
WITH e AS MATERIALIZED (SELECT s_nationkey AS source, c_nationkey AS target, count(*)::DOUBLE AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
   JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE abs(s_nationkey - c_nationkey) BETWEEN 1 AND 5 GROUP BY 1, 2),
d0 AS MATERIALIZED (SELECT n_nationkey AS origin, n_nationkey AS node, 0.0::DOUBLE AS cost FROM nation),
{", ".join(f"d{i} AS MATERIALIZED (SELECT origin, node, min(cost) AS cost FROM (SELECT * FROM d{i - 1} UNION ALL SELECT origin, target, d{i - 1}.cost + e.cost FROM d{i - 1} JOIN e ON source = node) GROUP BY 1, 2)" for i in range(1, 25))}
SELECT origin, node AS target, cost AS agg_cost FROM d24 WHERE origin <> node
""")
def shortest_path_pairs(spark, t):
    """Least cost from every nation to every other, read at the last node of each path."""
    ends = t.nation.select(F.lit(1).alias("k"), "n_nationkey")
    pairs = ends.join(ends.withColumnRenamed("n_nationkey", "other"), "k").where("n_nationkey != other").select("n_nationkey", "other")
    paths = graph.routes(trade_lanes(t), pairs)
    return paths.where(F.col("node") == F.col("target")).select("origin", "target", "agg_cost")

"""Queries over points, polygons, tiles and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.operators import geo
from lodework.plans.registry import plan

POINT_SQL = ("SELECT c_custkey, c_nationkey, CAST((c_custkey * 7919 % 36000) AS DOUBLE) / 100.0 - 180 AS lon, "
             "CAST((c_custkey * 104729 % 18000) AS DOUBLE) / 100.0 - 90 AS lat FROM customer")
SITE_SQL = ("SELECT s_suppkey, CAST((s_suppkey * 15485863 % 36000) AS DOUBLE) / 100.0 - 180 AS slon, "
            "CAST((s_suppkey * 32452843 % 18000) AS DOUBLE) / 100.0 - 90 AS slat FROM supplier")


def points(spark, t):
    return spark.sql(POINT_SQL.replace("customer", "{c}"), c=t.customer)


def sites(spark, t):
    return spark.sql(SITE_SQL.replace("supplier", "{s}"), s=t.supplier)


ANGLE = "2 * asin(sqrt(least(1.0, power(sin(({b2} - {a2}) / 2), 2) + cos({a2}) * cos({b2}) * power(sin(({b1} - {a1}) / 2), 2))))"
DIST_SQL = ANGLE.format(a1="radians(lon)", a2="radians(lat)", b1="radians(clon)", b2="radians(clat)")
BOXES_SQL = """SELECT n_nationkey, CAST(-180 + 72 * (n_nationkey % 5) - 3.5 AS DOUBLE) AS x1, CAST(-90 + 36 * (n_nationkey // 5) - 2.25 AS DOUBLE) AS y1,
  CAST(-180 + 72 * (n_nationkey % 5) + 50 + n_nationkey AS DOUBLE) AS x2, CAST(-90 + 36 * (n_nationkey // 5) + 20 + n_nationkey AS DOUBLE) AS y2 FROM nation"""


@plan("geo_distance", f"""
WITH p AS ({POINT_SQL}), n AS (SELECT n_nationkey, n_nationkey * 14.0::DOUBLE - 170 AS clon, n_nationkey * 7.0::DOUBLE - 85 AS clat FROM nation)
SELECT c_custkey, round({DIST_SQL} * 6371008.8, 2) AS metres FROM p JOIN n ON c_nationkey = n_nationkey
""")
def geo_distance(spark, t):
    homes = t.nation.select("n_nationkey", (F.col("n_nationkey") * F.lit(14.0) - 170).alias("clon"), (F.col("n_nationkey") * F.lit(7.0) - 85).alias("clat"))
    joined = points(spark, t).join(homes, F.col("c_nationkey") == F.col("n_nationkey"))
    metres = geo.geo_distance_m(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat"))
    return joined.select("c_custkey", F.round(metres, 2).alias("metres"))


@plan("spatial_join_contains", f"""
WITH p AS ({POINT_SQL}), b AS ({BOXES_SQL})
SELECT c_custkey, n_nationkey FROM p JOIN b ON lon > x1 AND lon < x2 AND lat > y1 AND lat < y2
""")
def spatial_join_contains(spark, t):
    boxes = spark.sql(BOXES_SQL.replace("nation\n", "{n}").replace("FROM nation", "FROM {n}").replace("n_nationkey // 5", "(n_nationkey div 5)"), n=t.nation)
    rings = boxes.select("n_nationkey", geo.envelope(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("ring"))
    return geo.contains_join(points(spark, t), rings, "lon", "lat").select("c_custkey", "n_nationkey")


@plan("spatial_dwithin", f"""
WITH p AS ({POINT_SQL}), s AS ({SITE_SQL})
SELECT c_custkey, s_suppkey FROM p JOIN s ON power(lon - slon, 2) + power(lat - slat, 2) <= 9
""")
def spatial_dwithin(spark, t):
    return geo.dwithin_join(points(spark, t), sites(spark, t), "lon", "lat", "slon", "slat", 3.0).select("c_custkey", "s_suppkey")


@plan("geojson_export", f"""
SELECT c_custkey, '{{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']}}' AS geojson,
       'POINT(' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS wkt FROM ({POINT_SQL})
""")
def geojson_export(spark, t):
    wkt = points(spark, t).select("c_custkey", geo.to_wkt(F.col("lon"), F.col("lat")).alias("wkt"))
    p = geo.read_wkt_point(F.col("wkt"))
    return wkt.select("c_custkey", geo.to_geojson(p["lon"], p["lat"]).alias("geojson"), "wkt")


TILE_SQL = """least(greatest(floor((lon + 180.0) / 360.0 * {n}), 0), {n} - 1)::BIGINT AS x,
 least(greatest(floor((1.0 - ln(tan(r) + 1.0 / cos(r)) / pi()) / 2.0 * {n}), 0), {n} - 1)::BIGINT AS y"""


@plan("tile_bins", f"""
WITH p AS (SELECT lon, radians(greatest(least(lat, 85.05112877980659), -85.05112877980659)) AS r FROM ({POINT_SQL})),
a AS (SELECT {TILE_SQL.format(n=32)} FROM p), c AS (SELECT 5::BIGINT AS z, x, y, count(*) AS points FROM a GROUP BY x, y)
SELECT * FROM c UNION ALL SELECT 4, x // 2, y // 2, CAST(sum(points) AS BIGINT) FROM c GROUP BY 2, 3
""")
def tile_counts(spark, t):
    tiles = geo.tile_bins(points(spark, t), "lon", "lat", 5)
    return tiles.unionByName(geo.parent_tiles(tiles))


@plan("hex_bins", f"""
WITH p AS (SELECT radians(lon) AS x, sin(radians(lat)) AS y FROM ({POINT_SQL})),
f AS (SELECT (sqrt(3) / 3 * x - y / 3) / 0.0625 AS q, (2.0 / 3 * y) / 0.0625 AS r FROM p),
g AS (SELECT q, r, -q - r AS s, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM f),
h AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM g),
c AS (SELECT CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS fq, CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS fr FROM h)
SELECT 3::BIGINT * 144115188075855872 + (fq::BIGINT + 134217728) * 268435456 + fr::BIGINT + 134217728 AS cell, count(*) AS points, 3::BIGINT AS resolution, 6::BIGINT AS corners
FROM c GROUP BY 1
""")
def hex_counts(spark, t):
    cell = F.col("cell")
    return geo.hex_bins(points(spark, t), "lon", "lat", 3).select(
        "cell", "points", geo.hex_resolution(cell).alias("resolution"), F.size(geo.hex_boundary(cell)).cast("long").alias("corners"))


@plan("spherical_crossmatch", f"""
WITH p AS (SELECT c_custkey, radians(lon) AS a1, radians(lat) AS a2 FROM ({POINT_SQL})), s AS (SELECT s_suppkey, radians(slon) AS b1, radians(slat) AS b2 FROM ({SITE_SQL}))
SELECT c_custkey, s_suppkey, round({ANGLE.format(a1='a1', a2='a2', b1='b1', b2='b2')}, 9) AS angle FROM p JOIN s ON {ANGLE.format(a1='a1', a2='a2', b1='b1', b2='b2')} <= 0.05
""")
def spherical_crossmatch(spark, t):
    a = points(spark, t).select("c_custkey", F.radians("lon").alias("a1"), F.radians("lat").alias("a2"))
    b = sites(spark, t).select("s_suppkey", F.radians("slon").alias("b1"), F.radians("slat").alias("b2"))
    return geo.cone_match(a, b, "a1", "a2", "b1", "b2", 0.05).select("c_custkey", "s_suppkey", F.round("angle", 9).alias("angle"))

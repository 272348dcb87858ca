"""Geography on a sphere: distances, containment and nearness joins, tiles and hex cells.

Coordinates are always (lon, lat) in degrees unless a function says radians.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.session import stage

#: Pairs of points of a cell that one task tests.
PAIRS = 1 << 22
EARTH_M = 6371008.8  # mean radius
GRID_LIMIT = 85.05112877980659  # latitude limit of Web Mercator


def central_angle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle angle in radians between points in radians (haversine form)."""
    h = (F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0))
         + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2.0)))
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geo_distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points in degrees."""
    return central_angle(F.radians(lon1), F.radians(lat1), F.radians(lon2), F.radians(lat2)) * EARTH_M


def envelope(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Rectangle as a ring of (x, y)."""
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Point strictly inside a simple polygon; a point on the boundary is not contained."""
    n = F.size(ring)
    edges = F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.element_at(ring, F.pmod(i + 1, n) + 1).alias("q")))

    def crosses(e):
        p, q = e["p"], e["q"]
        spans = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / F.when(spans, q["y"] - p["y"])
        return spans & (x < at)

    def touches(e):
        p, q = e["p"], e["q"]
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return ((cross == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"]))
                & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])))

    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return inside & ~F.exists(edges, touches)


def contains_join(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str = "ring") -> DataFrame:
    """(point row, polygon row) for each point inside a polygon.

    Every polygon is filed under the grid level whose cells are at least as large as its bounding box, so
    it covers at most four cells whatever its size; points are looked up once per level in use (few).
    The bounding box and then the exact test decide.
    """
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    boxed = polygons.select("*", F.array_min(xs).alias("_x1"), F.array_max(xs).alias("_x2"),
                            F.array_min(ys).alias("_y1"), F.array_max(ys).alias("_y2"))
    extent = F.greatest(F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1"), F.lit(1e-9))
    filed = boxed.withColumn("_level", F.ceil(F.log2(extent)).cast("int"))
    size = F.pow(F.lit(2.0), F.col("_level"))

    def cell(v, s):
        return F.floor(v / s).cast("long")

    cells = (filed.select("*", F.explode(F.sequence(cell(F.col("_x1"), size), cell(F.col("_x2"), size))).alias("_cx"))
             .select("*", F.explode(F.sequence(cell(F.col("_y1"), size), cell(F.col("_y2"), size))).alias("_cy")))
    # at most one value per power of two between the smallest and the largest polygon
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())
    if not levels:
        return points.join(polygons, F.lit(False))
    keys = F.array(*[F.struct(F.lit(n).alias("l"), cell(F.col(x), F.lit(2.0 ** n)).alias("cx"),
                              cell(F.col(y), F.lit(2.0 ** n)).alias("cy")) for n in levels])
    spread = points.select("*", F.inline(keys).alias("_l", "_px", "_py"))
    on = (F.col("_l") == F.col("_level")) & (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy"))
    box = F.col(x).between(F.col("_x1"), F.col("_x2")) & F.col(y).between(F.col("_y1"), F.col("_y2"))
    return (spread.join(cells, on & box).where(in_ring(F.col(x), F.col(y), F.col(ring)))
            .select(*points.columns, *polygons.columns))


def _cell_join(a: DataFrame, b: DataFrame, a_at: list[Column], b_at: list[Column], size: float, near: Column) -> DataFrame:
    """Pairs that satisfy ``near`` among points of equal or neighbouring cells; ``b`` visits its neighbours.

    The points of ``a`` in a cell where more than ``PAIRS`` pairs meet are dealt into shares, each of which meets all of
    ``b`` there, so no task has much more than that at once.
    """
    dims = range(len(a_at))
    lhs = a.select("*", *[F.floor(c / size).cast("long").alias(f"_a{i}") for i, c in enumerate(a_at)])
    rhs = b.select("*", *[F.floor(c / size).cast("long").alias(f"_c{i}") for i, c in enumerate(b_at)])
    for i in dims:
        base = F.col(f"_c{i}")
        rhs = rhs.select("*", F.explode(F.array(base - 1, base, base + 1)).alias(f"_b{i}"))
    mine, theirs = [f"_a{i}" for i in dims], [f"_b{i}" for i in dims]
    sizes = (lhs.groupBy(*mine).agg(F.count(F.lit(1)).cast("double").alias("_n"))
             .join(rhs.groupBy(*[F.col(t).alias(m) for m, t in zip(mine, theirs)]).agg(F.count(F.lit(1)).cast("double").alias("_m")), mine))
    shares = F.ceil(F.col("_n") * F.col("_m") / PAIRS)
    crowded = stage(sizes.select(*mine, F.least(shares, F.col("_n").cast("long")).alias("_shares")).where("_shares > 1"), "crowded-cells")
    lhs = lhs.join(crowded, mine, "left").withColumn("_as", F.pmod(F.monotonically_increasing_id(), F.coalesce("_shares", F.lit(1))))
    rhs = rhs.join(crowded.toDF(*theirs, "_others"), theirs, "left").withColumn("_bs", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_others", F.lit(1)) - 1)))
    # the files may be few and the sides small, the pairs many: a fixed number of tasks, and no copy of ``b`` in each
    lhs = lhs.repartition(4 * a.sparkSession.sparkContext.defaultParallelism, *mine, "_as")
    on = near & (F.col("_as") == F.col("_bs"))
    for m, t in zip(mine, theirs):
        on = on & (F.col(m) == F.col(t))
    return lhs.join(rhs.hint("merge"), on).select(*a.columns, *b.columns)


def dwithin_join(a: DataFrame, b: DataFrame, ax: str, ay: str, bx: str, by: str, d: float) -> DataFrame:
    """Pairs at most ``d`` apart in the plane (degrees for degree coordinates)."""
    gap = F.pow(F.col(ax) - F.col(bx), F.lit(2.0)) + F.pow(F.col(ay) - F.col(by), F.lit(2.0))
    return _cell_join(a, b, [F.col(ax), F.col(ay)], [F.col(bx), F.col(by)], d, gap <= F.lit(d * d))


def cone_match(a: DataFrame, b: DataFrame, a_lon: str, a_lat: str, b_lon: str, b_lat: str, radius: float) -> DataFrame:
    """Pairs within a great-circle ``radius`` (radians; coordinates in radians) with their ``angle``.

    Points become unit vectors and meet in cubes as wide as the chord of the radius: no special case at
    the poles or where the angle wraps.
    """
    def vector(lon, lat):
        return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]

    angle = central_angle(F.col(a_lon), F.col(a_lat), F.col(b_lon), F.col(b_lat))
    chord = 2 * math.sin(min(radius, math.pi) / 2) * (1 + 1e-9) + 1e-12
    pairs = _cell_join(a, b, vector(F.col(a_lon), F.col(a_lat)), vector(F.col(b_lon), F.col(b_lat)), chord, angle <= radius)
    return pairs.withColumn("angle", angle)


def same_spherical_point(lon1: Column, lat1: Column, lon2: Column, lat2: Column, eps: float = 1e-10) -> Column:
    return central_angle(lon1, lat1, lon2, lat2) <= eps


def read_wkt_point(text: Column) -> Column:
    """struct(lon, lat) of ``POINT(x y)``; NULL for other text."""
    pattern = r"(?i)^\s*POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)\s*$"
    lon, lat = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def to_wkt(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def to_geojson(lon: Column, lat: Column) -> Column:
    """GeoJSON text of a point."""
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def ring_geojson(ring: Column) -> Column:
    """GeoJSON text of a polygon without holes."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"),
                              F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))


def tile_of(lon: Column, lat: Column, zoom: int) -> Column:
    """struct(x, y) of the Web Mercator map tile."""
    n = 2 ** zoom
    rad = F.radians(F.greatest(F.least(lat, F.lit(GRID_LIMIT)), F.lit(-GRID_LIMIT)))
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.ln(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n)

    def inside(v):
        return F.greatest(F.least(v, F.lit(n - 1)), F.lit(0)).cast("long")

    return F.struct(inside(x).alias("x"), inside(y).alias("y"))


def tile_bins(df: DataFrame, lon: str, lat: str, zoom: int, *aggs: Column) -> DataFrame:
    """(z, x, y, points and further aggregates) per map tile."""
    tile = df.withColumn("_t", tile_of(F.col(lon), F.col(lat), zoom))
    return tile.groupBy(F.lit(zoom).cast("long").alias("z"), F.col("_t.x").alias("x"), F.col("_t.y").alias("y")).agg(
        F.count(F.lit(1)).alias("points"), *aggs)


def parent_tiles(tiles: DataFrame, levels: int = 1) -> DataFrame:
    """Counts of the tiles ``levels`` zoom steps up, from the counts below."""
    return tiles.groupBy((F.col("z") - levels).alias("z"), F.shiftright("x", levels).alias("x"),
                         F.shiftright("y", levels).alias("y")).agg(F.sum("points").alias("points"))


# Hex cells: pointy-top hexagons on the cylindrical equal-area projection x = lon, y = sin(lat), in radians.
HEX_OFFSET = 2 ** 27


def hex_size(res: int) -> float:
    """Edge length of a cell in projected units; each resolution is half the one above."""
    return 0.5 / 2 ** res


def _axial(lon: Column, lat: Column, res: int) -> tuple[Column, Column]:
    """Axial coordinates of a point, not yet rounded."""
    size = hex_size(res)
    x, y = F.radians(lon), F.sin(F.radians(lat))
    return (math.sqrt(3) / 3 * x - y / 3) / size, (2.0 / 3 * y) / size


def hex_cell(lon: Column, lat: Column, res: int) -> Column:
    """Cell id of a point in degrees: resolution in the top bits, then the two axial coordinates."""
    return _nearest_cell(*_axial(lon, lat, res), res)


def with_hex_cell(df: DataFrame, lon: Column, lat: Column, res: int, name: str = "cell") -> DataFrame:
    """Adds the cell id; the coordinates are computed once as columns, since rounding mentions them often."""
    q, r = _axial(lon, lat, res)
    placed = df.withColumns({"_q": q, "_r": r})
    return placed.withColumn(name, _nearest_cell(F.col("_q"), F.col("_r"), res)).drop("_q", "_r")


def _nearest_cell(q: Column, r: Column, res: int) -> Column:
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return (F.lit(res).cast("long") * 2 ** 57 + (fq.cast("long") + HEX_OFFSET) * 2 ** 28 + fr.cast("long") + HEX_OFFSET)


def hex_resolution(cell: Column) -> Column:
    return F.shiftright(cell, 57)


def hex_centre(cell: Column) -> Column:
    """struct(lon, lat) of the centre of a cell; latitude is cut at the poles."""
    size = 0.5 / F.pow(F.lit(2.0), hex_resolution(cell).cast("double"))
    q = F.shiftright(cell, 28).bitwiseAND(F.lit(2 ** 28 - 1)) - HEX_OFFSET
    r = cell.bitwiseAND(F.lit(2 ** 28 - 1)) - HEX_OFFSET
    x, y = size * math.sqrt(3) * (q + r / 2), size * 1.5 * r
    return F.struct(F.degrees(x).alias("lon"), F.degrees(F.asin(F.greatest(F.least(y, F.lit(1.0)), F.lit(-1.0)))).alias("lat"))


def hex_boundary(cell: Column) -> Column:
    """The six corners of a cell as (x, y) degrees."""
    size = 0.5 / F.pow(F.lit(2.0), hex_resolution(cell).cast("double"))
    centre = hex_centre(cell)
    cx, cy = F.radians(centre["lon"]), F.sin(F.radians(centre["lat"]))
    corners = []
    for i in range(6):
        turn = math.radians(60 * i - 30)
        y = F.greatest(F.least(cy + size * math.sin(turn), F.lit(1.0)), F.lit(-1.0))
        corners.append(F.struct(F.degrees(cx + size * math.cos(turn)).alias("x"), F.degrees(F.asin(y)).alias("y")))
    return F.array(*corners)


def hex_bins(df: DataFrame, lon: str, lat: str, res: int, *aggs: Column) -> DataFrame:
    """(cell, points and further aggregates) per hex cell."""
    return with_hex_cell(df, F.col(lon), F.col(lat), res).groupBy("cell").agg(F.count(F.lit(1)).alias("points"), *aggs)


def hex_rollup(cells: DataFrame, res: int) -> DataFrame:
    """Counts per coarser cell; a cell belongs to the coarser cell that holds its centre."""
    placed = cells.withColumn("_at", hex_centre(F.col("cell")))
    return with_hex_cell(placed, F.col("_at.lon"), F.col("_at.lat"), res).groupBy("cell").agg(F.sum("points").alias("points"))

"""Polygons over cells of the sphere: covers that answer point in polygon by equal cells, and cells dissolved into rings.

Polygons are tables of directed edges (polygon, x1, y1, x2, y2) in degrees; all rings of one, holes too, have its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.geo import KM_LAT, KM_LON
from wakeline.functions.hexsphere import HexSphere
from wakeline.sources import files

#: Mean edge of a cell at resolution 0 in km, as published; a cell's own edge is at least half of its resolution's mean.
EDGE_KM, LEAST = 1281.256011, 0.5
#: Parts into which the cover's row of a cell, and the points of that cell, are dealt.
SALTS = 8
_EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = files.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _crosses(e: Column, lat: Column, lon: Column, other: Column) -> Column:
    """Whether the edge lies between two points of one latitude, as a ray to the east counts it."""
    x = (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
    return ((e["y1"] > lat) != (e["y2"] > lat)) & ((lon < x) != (other < x))


def _crosses_down(e: Column, lon: Column, lat: Column, other: Column) -> Column:
    """The same between two points of one longitude."""
    y = (e["y2"] - e["y1"]) * (lon - e["x1"]) / (e["x2"] - e["x1"]) + e["y1"]
    return ((e["x1"] > lon) != (e["x2"] > lon)) & ((lat < y) != (other < y))


def in_bands(points: DataFrame, edges: DataFrame, keys: list[str], key: str, band: float) -> DataFrame:
    """(*keys, key) of the points (*keys, lat, lon, and key if they ask for one only) that lie in polygons `key` of edges.

    Crossing parity, where points meet only the edges of their band of latitude, by an equi join.
    """
    floor = lambda c: F.floor(c / band)
    dealt = edges.withColumn("band", F.explode(F.sequence(floor(F.least("y1", "y2")), floor(F.greatest("y1", "y2")))))
    asked = points.withColumn("band", floor(F.col("lat")))
    on = ["band", key] if key in points.columns else ["band"]
    e = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}
    x = (e["x2"] - e["x1"]) * (F.col("lat") - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
    hit = asked.join(dealt, on).where(((e["y1"] > F.col("lat")) != (e["y2"] > F.col("lat"))) & (F.col("lon") < x))
    return hit.groupBy(*keys, key).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*keys, key)


def cover(edges: DataFrame, res: int, salts: int = SALTS) -> DataFrame:
    """(polygon, cell, salt, inside, lat, lon, edges): all cells that each polygon touches, on the grid of resolution res.

    Cells that no edge comes near have edges null and are inside as a whole. The others have the edges near them, and whether
    their centre (lat, lon) is inside. Edges are followed in steps of a quarter of the least cell's edge and given
    to the cells met and their neighbours, which holds all that crosses a cell's box. Each cell is there salts times.
    Polygons that cross 180 degrees, or hold a pole, must be cut there first; a ring's edges may come in any order.
    """
    grid = HexSphere(res)
    km = EDGE_KM / math.sqrt(7) ** res * LEAST
    lat, lon = F.col("lat"), F.col("lon")
    length = F.greatest(F.abs(F.col("x2") - F.col("x1")) * KM_LON, F.abs(F.col("y2") - F.col("y1")) * KM_LAT)
    steps = edges.withColumn("_n", F.ceil(length * 1.5 / (km / 4)).cast("int") + 1).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    part = F.col("_k") / F.col("_n")
    steps = steps.withColumns({"lat": F.col("y1") + (F.col("y2") - F.col("y1")) * part, "lon": F.col("x1") + (F.col("x2") - F.col("x1")) * part})
    named = ("polygon", "x1", "y1", "x2", "y2")
    met = _saved(steps.select(*named, grid.cell(lat, lon).alias("met")).distinct(), "met")
    # a cell's disk is worked out once, however many edges meet it
    disks = met.select("met").distinct().select("met", F.explode(grid.disk(F.col("met"))).alias("cell"))
    edge = F.struct("x1", "y1", "x2", "y2")
    near = met.join(disks, "met").select(*named, "cell").distinct().groupBy("polygon", "cell").agg(F.collect_list(edge).cast(_EDGES).alias("edges"))
    # every cell within a polygon's box has a point of a grid so fine
    box = edges.groupBy("polygon").agg(*(f(F.least(a, b) if f is F.min else F.greatest(a, b)).alias(n) for f, a, b, n in ((F.min, "x1", "x2", "_w"), (F.max, "x1", "x2", "_o"), (F.min, "y1", "y2", "_s"), (F.max, "y1", "y2", "_t"))))
    down = km / KM_LAT
    rows = box.withColumn("_i", F.explode(F.sequence(F.lit(0), F.ceil((F.col("_t") - F.col("_s")) / down).cast("int")))).withColumn("lat", F.col("_s") + F.col("_i") * down)
    across = F.lit(km / KM_LON) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    points = rows.repartition("polygon", "_i").withColumn("_j", F.explode(F.sequence(F.lit(0), F.ceil((F.col("_o") - F.col("_w")) / across).cast("int"))))
    filled = points.select("polygon", grid.cell(lat, F.col("_w") + F.col("_j") * across).alias("cell")).distinct()
    cells = _saved(filled.join(near, ["polygon", "cell"], "full"), "cells").withColumn("at", grid.centre(F.col("cell")))
    cells = cells.select("polygon", "cell", "edges", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"))
    inside = in_bands(cells.select("polygon", "cell", "lat", "lon"), edges, ["cell"], "polygon", 4 * down).withColumn("inside", F.lit(True))
    out = cells.join(inside, ["polygon", "cell"], "left").withColumn("inside", F.coalesce("inside", F.lit(False))).where("inside OR edges IS NOT NULL")
    out = _saved(out.select("polygon", "cell", "inside", "lat", "lon", "edges"), "cover")
    return out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def within(points: DataFrame, covering: DataFrame, res: int, salts: int = SALTS, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The points (all columns) with each polygon that they lie in, by crossing parity; those in none have no row.

    An equi join by cell. A point of a cell that edges come near is compared with the cell's centre: it is on the other side as often
    as edges lie on the way, along its latitude and then down the centre's longitude.
    """
    own = points.select(F.struct(*points.columns).alias("_p"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    own = own.withColumns({"cell": HexSphere(res).cell(F.col("_lat"), F.col("_lon")), "salt": F.pmod(F.xxhash64("_lat", "_lon"), F.lit(salts)).cast("int")}).where("cell IS NOT NULL")
    side = lambda a, e: (a != _crosses(e, F.col("_lat"), F.col("_lon"), F.col("lon"))) != _crosses_down(e, F.col("lon"), F.col("_lat"), F.col("lat"))
    hit = F.when(F.col("edges").isNull(), F.col("inside")).otherwise(F.aggregate("edges", F.col("inside"), side))
    return own.join(covering, ["cell", "salt"]).where(hit).select("_p.*", "polygon")


def outline(cells: DataFrame, grid: HexSphere) -> DataFrame:
    """(a, b, x1, y1, x2, y2): the sides between cells of the set (column cell) and others, with the set on their left.

    Corners are named by the three cells that meet there, so that neighbours agree on them to the last digit.
    """
    each = cells.select("cell").distinct().withColumn("sides", grid.sides(F.col("cell")))
    n, i = F.size("sides"), F.col("i")
    at = lambda k: F.element_at("sides", F.pmod(k, n) + 1)
    sides = each.select("cell", "sides", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    name = lambda p, q: F.array_join(F.transform(F.array_sort(F.array("cell", p["neighbour"], q["neighbour"])), lambda c: F.hex(c)), "-")
    edge = sides.select(at(i)["neighbour"].alias("neighbour"), name(at(i - 1), at(i)).alias("a"), name(at(i), at(i + 1)).alias("b"), *(at(k)[c].alias(o) for k, c, o in ((i - 1, "lon", "x1"), (i - 1, "lat", "y1"), (i, "lon", "x2"), (i, "lat", "y2"))))
    return edge.join(each.select(F.col("cell").alias("neighbour")), "neighbour", "left_anti").drop("neighbour")


def rings(edges: DataFrame) -> DataFrame:
    """(ring, outer, area, points): the outline's sides chained into closed rings; holes have a negative area.

    outer is the smallest ring around a hole, and a ring's own name for those that aren't holes; points are structs of (lon, lat), the
    first one repeated at the end. Two chains by doubling: the least corner that can be reached names the ring, then
    distances to it give the order; each round joins a table with itself on corners, as many rounds as the logarithm of
    the longest ring. Cells that meet only in a corner don't exist on this grid, so each corner has one side on.
    """
    edges = _saved(edges, "sides")
    state = edges.select(F.col("a").alias("v"), F.col("b").alias("to"), F.col("a").alias("ring"))
    while True:
        on = state.select(F.col("v").alias("to"), F.col("to").alias("far"), F.col("ring").alias("other"))
        state = _saved(state.join(on, "to").select("v", F.col("far").alias("to"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("changed")), "names")
        if state.where("changed").isEmpty():
            break
    named = state.select("v", "ring")
    way = _saved(edges.join(named, edges["a"] == named["v"]).select("v", "ring", F.when(F.col("v") == F.col("ring"), F.col("v")).otherwise(F.col("b")).alias("to"), F.when(F.col("v") == F.col("ring"), 0).otherwise(1).cast("long").alias("d")), "ways")
    while not way.where("to <> ring").isEmpty():
        on = way.select(F.col("v").alias("to"), F.col("to").alias("far"), F.col("d").alias("more"))
        way = _saved(way.join(on, "to").select("v", "ring", F.col("far").alias("to"), (F.col("d") + F.col("more")).alias("d")), "ways")
    placed = edges.join(way, edges["a"] == way["v"]).select("ring", F.when(F.col("d") > 0, -F.col("d")).otherwise(F.lit(-(2**62))).alias("k"), *("x1", "y1", "x2", "y2"))
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    points = F.transform(F.array_sort(F.collect_list(F.struct("k", "x1", "y1"))), lambda p: F.struct(p["x1"].alias("lon"), p["y1"].alias("lat")))
    whole = _saved(placed.groupBy("ring").agg(area.alias("area"), F.concat(points, F.slice(points, 1, 1)).alias("points")), "rings")
    # a hole's corner lies on no other ring, so parity is sure
    holes = whole.where("area < 0").select(F.col("ring").alias("hole"), F.element_at("points", 1)["lat"].alias("lat"), F.element_at("points", 1)["lon"].alias("lon"))
    sizes = whole.where("area >= 0").select("ring", F.col("area").alias("size"))
    around = in_bands(holes, placed.join(sizes, "ring", "left_semi"), ["hole"], "ring", 0.1).join(sizes, "ring")
    best = around.groupBy("hole").agg(F.min_by("ring", "size").alias("outer"))
    return whole.join(best, F.col("ring") == F.col("hole"), "left").select("ring", F.coalesce("outer", "ring").alias("outer"), "area", "points")


def ring_edges(found: DataFrame) -> DataFrame:
    """Rings -> directed edges (polygon, x1, y1, x2, y2), named by the outer ring."""
    one = lambda p, i: F.struct(p["lon"].alias("x1"), p["lat"].alias("y1"), F.get("points", i + 1)["lon"].alias("x2"), F.get("points", i + 1)["lat"].alias("y2"))
    each = F.transform(F.slice(F.col("points"), 1, F.size("points") - 1), one)
    return found.select(F.col("outer").alias("polygon"), F.inline(each))


def box_polygons(boxes: DataFrame, polygon: str, x1: Column, y1: Column, x2: Column, y2: Column) -> DataFrame:
    """Edges of a rectangle for each row."""
    at = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    edge = lambda p, q: F.struct(*(v.cast("double").alias(n) for v, n in zip((*p, *q), ("x1", "y1", "x2", "y2"), strict=True)))
    return boxes.select(F.col(polygon).alias("polygon"), F.inline(F.array(*(edge(p, q) for p, q in zip(at, at[1:], strict=False)))))

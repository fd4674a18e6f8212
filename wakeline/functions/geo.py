"""Great-circle distance and bearing, a planar hexagonal grid, and point in polygon, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: mean earth radius, kilometres in a knot, kilometres per degree
EARTH_KM, KNOT_KM = 6371.0088, 1.852
KM_LAT, KM_LON = 110.57, 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points in degrees, null if one is unknown; the root is held to 1 against rounding."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # F.least alone would take null for 1
    return F.when(h.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0


def speed_kn(km: Column, seconds: Column) -> Column:
    """Knots; null unless time has passed."""
    return F.when(seconds > 0, km / (seconds / F.lit(3600.0)) / KNOT_KM)


class HexGrid:
    """Hexagons of one edge length on a local plane; cells are 'q:r' strings."""

    def __init__(self, edge_km: float = 1.4, lat0: float = 33.7, lon0: float = -118.2) -> None:
        self.edge, self.lat0, self.lon0 = edge_km, lat0, lon0
        self.km_lon = KM_LON * math.cos(math.radians(lat0))

    @classmethod
    def of(cls, res: int, lat0: float = 33.7, lon0: float = -118.2) -> HexGrid:
        """A grid with the mean edge of an aperture-7 grid of that resolution: res 7 is about 1.41 km."""
        return cls(1281.256011 / math.sqrt(7) ** res, lat0, lon0)

    def axial(self, lat: Column, lon: Column) -> Column:
        """struct<q, r> of the cell. Arrays of one bind what is used more than once, which keeps the generated code small."""
        x, y = (lon - self.lon0) * self.km_lon, (lat - self.lat0) * KM_LAT
        at = F.struct(((math.sqrt(3) / 3 * x - y / 3.0) / self.edge).alias("q"), ((2.0 / 3.0 * y) / self.edge).alias("r"))
        near = lambda z: F.struct(*(f(v).alias(f"{n}{k}") for v, k in ((z["q"], "q"), (z["r"], "r"), (-z["q"] - z["r"], "s")) for n, f in (("r", F.round), ("d", lambda v: F.abs(F.round(v) - v)))))

        def pick(z: Column) -> Column:
            off_q = (z["dq"] > z["dr"]) & (z["dq"] > z["ds"])
            q = F.when(off_q, -z["rr"] - z["rs"]).otherwise(z["rq"])
            r = F.when(off_q, z["rr"]).when(z["dr"] > z["ds"], -z["rq"] - z["rs"]).otherwise(z["rr"])
            return F.struct(q.cast("int").alias("q"), r.cast("int").alias("r"))

        return F.element_at(F.transform(F.transform(F.array(at), near), pick), 1)

    def cell(self, lat: Column, lon: Column) -> Column:
        text = lambda z: F.concat_ws(":", z["q"].cast("string"), z["r"].cast("string"))
        return F.element_at(F.transform(F.array(self.axial(lat, lon)), text), 1)

    def disk(self, cell: Column, k: int = 1) -> Column:
        """The cells within k steps: 7 for k = 1, the cell and its six neighbours."""
        steps = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a + b) <= k]
        part = lambda p, i, d: (F.element_at(p, i).cast("int") + d).cast("string")
        around = lambda p: F.array(*(F.concat_ws(":", part(p, 1, a), part(p, 2, b)) for a, b in steps))
        return F.element_at(F.transform(F.array(F.split(cell, ":")), around), 1)

    def corners(self, cell: Column) -> Column:
        """Six corners as (lat, lon), from the north-east one counter-clockwise."""
        q, r = (F.element_at(F.split(cell, ":"), i).cast("double") for i in (1, 2))
        x, y = self.edge * math.sqrt(3) * (q + r / 2.0), self.edge * 1.5 * r
        at = [math.radians(60 * k + 30) for k in range(6)]
        return F.array(*(F.struct((F.lit(self.lat0) + (y + self.edge * math.sin(a)) / KM_LAT).alias("lat"), (F.lit(self.lon0) + (x + self.edge * math.cos(a)) / self.km_lon).alias("lon")) for a in at))


def outline(cells: DataFrame, grid: HexGrid) -> DataFrame:
    """(x1, y1, x2, y2): the edges around a set of cells; those between two of its cells go."""
    ring = cells.select("cell", F.posexplode(grid.corners(F.col("cell"))).alias("k", "at"), grid.corners(F.col("cell")).alias("ring"))
    ends = ring.select(F.col("at").alias("a"), F.element_at("ring", (F.col("k") + 1) % 6 + 1).alias("b"))
    # a shared corner differs in its last digits from cell to cell
    name = lambda p: F.concat_ws(",", F.format_string("%.7f", p["lon"]), F.format_string("%.7f", p["lat"]))
    keyed = ends.withColumns({"ka": name(F.col("a")), "kb": name(F.col("b"))})
    once = keyed.groupBy(F.least("ka", "kb").alias("p"), F.greatest("ka", "kb").alias("q")).agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")).where("n = 1")
    return once.select(F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("b.lon").alias("x2"), F.col("b.lat").alias("y2"))


def in_edges(points: DataFrame, edges: DataFrame, name: str = "inside") -> DataFrame:
    """points with name: crossing parity against any number of closed rings given as an edge table.

    The edges of a polygon are one row, broadcast with it; a polygon is bounded by its outline, not by points.
    """
    e = edges.agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_e"), F.min("x1").alias("_w"), F.max("x1").alias("_o"), F.min("y1").alias("_s"), F.max("y1").alias("_n"))
    box = F.col("lon").between(F.col("_w"), F.col("_o")) & F.col("lat").between(F.col("_s"), F.col("_n"))
    inside = F.coalesce(F.when(box, parity(F.col("lat"), F.col("lon"), F.col("_e"))), F.lit(False))
    return points.crossJoin(F.broadcast(e)).withColumn(name, inside).drop("_e", "_w", "_o", "_s", "_n")


def parity(lat: Column, lon: Column, rings: Column) -> Column:
    """Whether a ray to the east crosses the edges an odd number of times."""
    crosses = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.aggregate(rings, F.lit(False), lambda a, e: a != crosses(e))


def centroid(edges: DataFrame) -> DataFrame:
    """(lon, lat): area centroid of rings given as directed edges, by the shoelace sum."""
    e = edges.withColumn("a", F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    sums = e.agg(F.sum("a").alias("a"), F.sum((F.col("x1") + F.col("x2")) * F.col("a")).alias("x"), F.sum((F.col("y1") + F.col("y2")) * F.col("a")).alias("y"))
    return sums.select((F.col("x") / F.col("a") / 3).alias("lon"), (F.col("y") / F.col("a") / 3).alias("lat"))


def in_rings(lat: Column, lon: Column, edges: list[tuple[float, float, float, float]]) -> Column:
    """Crossing parity against edges (lon1, lat1, lon2, lat2) of closed rings, in one expression."""
    rings = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e, strict=True))) for e in edges))
    return parity(lat, lon, rings)


def box_edges(x1: float, y1: float, x2: float, y2: float) -> list[tuple[float, float, float, float]]:
    ring = closed_ring((x1, y1, x2, y2))
    return [(*a, *b) for a, b in zip(ring, ring[1:], strict=False)]


def closed_ring(box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A box (west, south, east, north) as the closed ring (lon, lat) that report APIs take as a polygon."""
    x1, y1, x2, y2 = box
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]

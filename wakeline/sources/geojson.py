"""GeoJSON polygons as edge tables, and cells as GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.geo import HexGrid

_FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>>"
_COLLECTION = f"struct<type:string,features:array<{_FEATURE}>,geometry:struct<type:string,coordinates:string>,coordinates:string>"
_RING = "array<array<double>>"


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(part, ring, k, x1, y1, x2, y2): the edges of all polygons and multipolygons of the files under path.

    A file is a feature collection, a feature or a geometry; other geometries are skipped. Holes are rings
    like others: crossing parity over all edges leaves them out. A file without polygons has no rows.
    """
    doc = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("file"), F.from_json("value", _COLLECTION).alias("d"))
    one = F.struct(F.col("d.type").alias("type"), F.col("d.coordinates").alias("coordinates"))
    shapes = F.when(F.col("d.features").isNotNull(), F.transform("d.features", lambda f: f["geometry"])).when(F.col("d.geometry").isNotNull(), F.array("d.geometry")).otherwise(F.array(one))
    each = doc.select("file", F.posexplode(shapes).alias("shape", "g"))
    single = F.from_json("g.coordinates", f"array<{_RING}>")
    many = F.from_json("g.coordinates", f"array<array<{_RING}>>")
    polygons = F.when(F.col("g.type") == "Polygon", F.array(single)).when(F.col("g.type") == "MultiPolygon", many)
    parts = each.select("file", "shape", F.posexplode(polygons).alias("polygon", "rings"))
    rings = parts.select(F.concat_ws(":", "file", "shape", "polygon").alias("part"), F.posexplode("rings").alias("ring", "at"))
    edges = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda i: F.struct(i.alias("k"), *(F.element_at(F.element_at("at", i + j), c).alias(f"{n}{j + 1}") for j in (0, 1) for n, c in (("x", 1), ("y", 2)))))
    return rings.where(F.size("at") > 1).select("part", "ring", F.inline(edges))


def write_cells(cells: DataFrame, grid: HexGrid, path: str) -> None:
    """The cells as one feature with a multipolygon, each cell a closed ring; a set of cells is few rows."""
    ring = grid.corners(F.col("cell"))
    point = lambda p: F.array(p["lon"], p["lat"])
    closed = F.transform(F.concat(ring, F.slice(ring, 1, 1)), point)
    shape = cells.select(F.array(closed).alias("polygon")).agg(F.collect_list("polygon").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), "coordinates").alias("geometry"), F.create_map().cast("map<string,string>").alias("properties"))
    whole = F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))
    shape.select(F.to_json(whole).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_rings(rings: DataFrame, path: str) -> None:
    """Rings (ring, outer, area, points) as GeoJSON: a file for each outer ring, a polygon with its holes."""
    own = F.transform("points", lambda p: F.array(p["lon"], p["lat"]))
    by = rings.groupBy("outer").agg(F.array_sort(F.collect_list(F.struct((F.col("ring") != F.col("outer")).alias("hole"), "ring", own.alias("at")))).alias("rings"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda r: r["at"]).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.create_map().cast("map<string,string>").alias("properties"))
    whole = F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))
    by.select(F.to_json(whole).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)

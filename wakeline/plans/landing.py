"""Named queries of sources, sinks, polygons, grids, styling and streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo, scalar
from wakeline.operators import ranked, track
from wakeline.plans import lens, sql
from wakeline.plans.queries import GRID, R4, _by_share, query, trajectory_summary
from wakeline.sources import files, geojson, landing
from wakeline.streaming import live

TYPED = "event_id long, ts timestamp_ntz, event_type string, value double"


def _typed(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("ts"), F.nullif("event_type", F.lit("view")).alias("event_type"), "value")


def _csv(s, d) -> str:
    path = files.scratch(s, "typed")
    _typed(s, d).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)
    return path


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, nullif(event_type, 'view') AS event_type, round(value, 4) AS value FROM events", "one AS (SELECT 1)")
def csv_timestamps(s, d):
    return files.read_csv(s, _csv(s, d), TYPED).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type", R4("value").alias("value"))


@query("SELECT count(*) AS written, count(*) AS n, count(DISTINCT event_id) AS ids FROM events", "one AS (SELECT 1)")
def csv_ingest(s, d):
    """CSV to Parquet with zstd; the count is observed while writing."""
    path = files.scratch(s, "bronze")
    n = files.ingest(files.read_csv(s, _csv(s, d), TYPED), path)
    return s.read.parquet(path).agg(F.lit(n).cast("long").alias("written"), F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1", "one AS (SELECT 1)")
def glob_scan(s, d):
    path = files.scratch(s, "days")
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", F.dayofmonth("ts").alias("day"))
    for k in (0, 1):
        e.where(F.col("day") % 2 == k).write.parquet(f"{path}/half={k}")
    return s.read.option("basePath", path).parquet(f"{path}/half=*/*.parquet").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY 1", "one AS (SELECT 1)")
def registered_relation(s, d):
    s.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("wakeline_events")
    return s.sql("SELECT event_type, round(avg(value), 4) AS mean FROM wakeline_events GROUP BY event_type")


@query("SELECT 1::BIGINT AS files, count(*) AS n FROM nation", "one AS (SELECT 1)")
def single_file_sink(s, d):
    path = files.scratch(s, "single")
    files.write_single(s.read.parquet(f"{d}/nation.parquet"), path)
    return s.read.parquet(path).select(F.input_file_name().alias("f")).agg(F.count_distinct("f").alias("files"), F.count("*").alias("n"))


@query("SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_name)) AS sha256, sum(length(r_name) + 1)::BIGINT AS bytes FROM region", "one AS (SELECT 1)")
def manifest_sha256(s, d):
    path = files.scratch(s, "manifest")
    s.read.parquet(f"{d}/region.parquet").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(path)
    return landing.manifest(s, path).where("name LIKE '%.txt'").select("sha256", "bytes")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INTEGER AS hour FROM events", "one AS (SELECT 1)")
def date_hour(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour"))


@query("SELECT event_id, split_part(event_type || '-' || event_id, '-', 2)::BIGINT AS tail, replace(event_type, 'i', 'I') AS swapped, printf('%s_%05d', event_type, event_id % 100000) AS name FROM lens")
def text_parts(s, d):
    joined = F.concat_ws("-", "event_type", F.col("event_id").cast("string"))
    return lens.pings(s, d).select("event_id", F.element_at(F.split(joined, "-"), 2).cast("long").alias("tail"), F.replace("event_type", F.lit("i"), F.lit("I")).alias("swapped"), F.format_string("%s_%05d", "event_type", F.col("event_id") % 100000).alias("name"))


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, '?') AS kind FROM lens")
def fillna_text(s, d):
    return lens.pings(s, d).select("event_id", F.nullif("event_type", F.lit("view")).alias("kind")).na.fill("?", ["kind"])


@query("SELECT event_id, 255 AS r, 900 AS radius, 'detection' AS label FROM lens")
def tolerant_style(s, d):
    """A table without the column dark, and without a flag, is styled as plain detections."""
    return scalar.styled(lens.pings(s, d).select("event_id", "lat", "lon")).select("event_id", "r", "radius", "label")


RGB = "greatest(0, least(255, floor(255 * (1.5 - abs(4 * x - {c})))))::INTEGER"


@query(f"SELECT event_id, {RGB.format(c=3)} AS r, {RGB.format(c=2)} AS g, {RGB.format(c=1)} AS b, 200::INTEGER AS a FROM (SELECT event_id, floor(greatest(0, least(1, coalesce(sog, 0) / 30::DOUBLE)) * 255) / 255::DOUBLE AS x FROM nulled)", sql.NULLED)
def color_rgb(s, d):
    x = scalar.shade(F.col("sog"), 0.0, 30.0)
    return track.without_sentinels(track.clip(lens.pings(s, d), *lens.BOX)).select("event_id", *(c.alias(n) for n, c in zip("rgba", scalar.rgba(x, 200), strict=True)))


@query("SELECT round(quantile_cont(v, 0.05), 4) AS p5, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99 FROM (SELECT CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v FROM lens)")
def color_bounds_nan(s, d):
    """NaN counts as missing."""
    v = F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.col("value"))
    numbers = lens.pings(s, d).select(v.alias("v")).where(~F.isnan("v"))
    return _by_share(ranked.quantiles(numbers, "v", [0.05, 0.95, 0.99]), (5, 95, 99))


@query("SELECT true AS agree, 0::BIGINT AS off")
def engines_agree(s, d):
    """The same figures by the DataFrame API and by SQL text: equal counts, kilometres within a thousandth."""
    lens.pings(s, d).createOrReplaceTempView("wakeline_lens")
    text = s.sql(
        "SELECT count(DISTINCT mmsi) AS n_vessels, count(*) AS n_points, sum(km) AS km FROM (SELECT mmsi, coalesce(2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat - la) / 2), 2)"
        " + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2))), 0) AS km FROM (SELECT *, lag(lat) OVER (PARTITION BY mmsi ORDER BY sec, event_id) AS la,"
        " lag(lon) OVER (PARTITION BY mmsi ORDER BY sec, event_id) AS lo FROM wakeline_lens))"
    )
    return scalar.agreement(trajectory_summary(s, d).unionByName(text))


# --- moored pings, their cells and the polygon around them

MOORED = f"""{sql.SILVER}, moored AS (SELECT * FROM silver WHERE sog < 1 AND lon BETWEEN {lens.PORT[0]} AND {lens.PORT[2]} AND lat BETWEEN {lens.PORT[1]} AND {lens.PORT[3]}),
cnt AS (SELECT cell, count(*) AS n FROM ({sql.HEX % "moored"}) GROUP BY 1),
kept AS (SELECT cell, n, split_part(cell, ':', 1)::INTEGER AS q, split_part(cell, ':', 2)::INTEGER AS r FROM (SELECT *, sum(n) OVER (ORDER BY n DESC, cell) - n AS before, sum(n) OVER () AS total FROM cnt) WHERE before < 0.9::DOUBLE * total)"""


def _moored(s, d) -> DataFrame:
    """Busiest cells with 90 % of the moored pings in the port's zone."""
    port = (F.col("sog") < 1.0) & F.col("lon").between(lens.PORT[0], lens.PORT[2]) & F.col("lat").between(lens.PORT[1], lens.PORT[3])
    cells = track.silver(lens.pings(s, d), lens.BOX).where(port).groupBy(GRID.cell(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count("*").alias("n"))
    return ranked.busiest(cells, 0.9)


@query("SELECT cell, n FROM kept", MOORED)
def moored_cells(s, d):
    return _moored(s, d)


@query("SELECT 6 * (SELECT count(*) FROM kept) - count(*) AS n_edges FROM kept a JOIN kept b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))", MOORED)
def moored_outline(s, d):
    """The outline of the cells: each side that two of them share is gone from both."""
    return geo.outline(_moored(s, d), GRID).agg(F.count("*").alias("n_edges"))


@query(f"SELECT event_id, cell IN (SELECT cell FROM kept) AS inside FROM ({sql.HEX % 'lens'})", MOORED)
def inside_outline(s, d):
    """Crossing parity against the outline says the same as the cells."""
    return geo.in_edges(lens.pings(s, d), geo.outline(_moored(s, d), GRID)).select("event_id", "inside")


@query(f"SELECT event_id, cell IN (SELECT cell FROM kept) AS inside FROM ({sql.HEX % 'lens'})", MOORED)
def geojson_inside(s, d):
    """The same by way of a GeoJSON file with a multipolygon."""
    path = files.scratch(s, "geojson")
    geojson.write_cells(_moored(s, d), GRID, path)
    return geo.in_edges(lens.pings(s, d), geojson.read_polygons(s, path)).select("event_id", "inside")


@query(f"SELECT round(avg(-118.2 + 1.4::DOUBLE * sqrt(3::DOUBLE) * (q + r / 2) / {sql.KLON!r}::DOUBLE), 4) AS lon, round(avg(33.7 + 1.4::DOUBLE * 1.5 * r / 110.57::DOUBLE), 4) AS lat FROM kept", MOORED)
def outline_centroid(s, d):
    return geo.centroid(geo.outline(_moored(s, d), GRID)).select(R4("lon").alias("lon"), R4("lat").alias("lat"))


EDGES = {res: 1281.256011 / math.sqrt(7) ** res for res in (5, 6, 7, 8)}


@query(" UNION ALL ".join(f"SELECT {res}::INTEGER AS res, count(DISTINCT cell) AS n_cells FROM ({sql.hexed('lens', repr(edge))})" for res, edge in EDGES.items()))
def hex_resolutions(s, d):
    p = lens.pings(s, d)
    cells = [F.struct(F.lit(res).alias("res"), geo.HexGrid.of(res).cell(F.col("lat"), F.col("lon")).alias("cell")) for res in EDGES]
    return p.select(F.inline(F.array(*cells))).groupBy("res").agg(F.count_distinct("cell").alias("n_cells"))


@query(f"SELECT cell, count(*) AS n, sum(a * a + a * b + b * b)::BIGINT AS far FROM (SELECT DISTINCT cell FROM ({sql.HEX % 'lens'})), (SELECT a, b FROM range(-2, 3) x(a), range(-2, 3) y(b) WHERE abs(a + b) <= 2) GROUP BY 1")
def hex_disk_2(s, d):
    """19 cells within two steps; far adds up the squared steps from the middle."""
    cells = lens.pings(s, d).select(GRID.cell(F.col("lat"), F.col("lon")).alias("cell")).distinct()
    at = lambda c, i: F.split_part(c, F.lit(":"), F.lit(i)).cast("int")
    near = cells.select("cell", F.explode(GRID.disk(F.col("cell"), 2)).alias("near"))
    a, b = (at(F.col("near"), i) - at(F.col("cell"), i) for i in (1, 2))
    return near.groupBy("cell").agg(F.count("*").alias("n"), F.sum(a * a + a * b + b * b).alias("far"))


# --- streams

@query("SELECT DISTINCT mmsi, sec // 3600 AS hour FROM lens")
def stream_dedup(s, d):
    path = files.scratch(s, "pings")
    lens.pings(s, d).select("mmsi", F.floor(F.col("sec") / 3600).alias("hour"), F.timestamp_seconds("sec").alias("at")).write.parquet(path)
    stream = s.readStream.schema("mmsi long, hour long, at timestamp").parquet(path)
    return live.landed(live.deduplicated(stream, ["mmsi", "hour"], "at", "60 days").select("mmsi", "hour"), "dedup")


@query("SELECT mmsi, sum(CASE WHEN sec - prev < 7200 THEN 0 ELSE 1 END)::BIGINT AS sessions, count(*) AS n FROM (SELECT mmsi, sec, lag(sec) OVER (PARTITION BY mmsi ORDER BY sec) AS prev FROM lens) GROUP BY 1")
def stream_sessions(s, d):
    """Runs of pings with less than two hours between them, by session windows."""
    path = files.scratch(s, "pings")
    lens.pings(s, d).select("mmsi", F.timestamp_seconds("sec").alias("at")).write.parquet(path)
    found = live.sessions(s.readStream.schema("mmsi long, at timestamp").parquet(path), "2 hours")
    return live.completed(found, "sessions").groupBy("mmsi").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("SELECT mmsi, prev AS t_start, sec AS t_end FROM (SELECT mmsi, sec, lag(sec) OVER (PARTITION BY mmsi ORDER BY sec, event_id) AS prev FROM lens) WHERE sec - prev > 1800")
def stream_gaps(s, d):
    """Silences of each vessel by keyed state, over two batches of files in time's order."""
    path = files.scratch(s, "pings")
    p = lens.pings(s, d).select("mmsi", "sec")
    middle = p.agg(F.expr("min(sec) + (max(sec) - min(sec)) div 2").alias("middle"))
    halves = p.crossJoin(F.broadcast(middle))
    files_each = 4
    halves.where("sec <= middle").drop("middle").repartition(files_each).write.parquet(path)
    halves.where("sec > middle").drop("middle").repartition(files_each).write.mode("append").parquet(path)
    stream = s.readStream.schema("mmsi long, sec long").option("maxFilesPerTrigger", files_each).parquet(path)
    return live.landed(live.gaps(stream, track.GAP_S), "gaps")


def _static(s, d) -> DataFrame:
    """Static reports whose fields are at times 0, empty or absent."""
    i = F.col("event_id")
    dims = F.struct((i % 3).alias("A"), (i % 2).alias("B"), F.when(i % 5 > 0, i % 4).alias("C"), (i % 2 * 0).alias("D"))
    imo = F.when(i % 4 == 0, F.lit("")).when(i % 4 == 1, F.lit("0")).otherwise(i.cast("string"))
    return lens.pings(s, d).select(F.to_json(F.struct(i.alias("Seq"), dims.alias("Dimension"), imo.alias("ImoNumber"))).alias("value"))


@query("SELECT event_id AS seq, nullif(event_id % 3 + event_id % 2, 0) AS length, nullif(CASE WHEN event_id % 5 > 0 THEN event_id % 4 ELSE 0 END, 0) AS width, CASE WHEN event_id % 4 < 2 THEN NULL ELSE event_id::VARCHAR END AS imo FROM lens")
def static_fields(s, d):
    return _static(s, d).select(live.static_fields(F.col("value")).alias("m")).select("m.*")


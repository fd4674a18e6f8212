"""Named queries of cells on the sphere, polygon covers and rings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import hexsphere
from wakeline.functions.hexsphere import HexSphere
from wakeline.operators import moving, polygons, ranked, sliced, track
from wakeline.plans import lens, sql
from wakeline.plans.queries import R4, query, saved
from wakeline.sources import archives, files, geojson
from wakeline.streaming import live, timers

RES, PORT_RES = 7, 8


def cells_sql(table: str, res: int, name: str) -> str:
    """Stages that add sid, the cell's id as a number, to the table: `name` is the last one."""
    frames = ", ".join(f"({f}, {', '.join(f'{x!r}::DOUBLE' for x in row)})" for f, row in enumerate(hexsphere._FRAMES))
    rows = ", ".join(f"({k}, {v})" for k, v in enumerate(hexsphere._encode_rows()) if v)
    c, s = (math.cos(hexsphere.TURN), math.sin(hexsphere.TURN)) if res % 2 else (1.0, 0.0)
    fine, third = math.sqrt(7) ** res / hexsphere.UNIT, 1 / math.sqrt(3)
    n = f"{name}_"
    out = [
        f"{n}f(face, nx, ny, nz, ex, ey, ez, gx, gy, gz) AS (VALUES {frames})",
        f"{n}v AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS vx, cos(radians(lat)) * sin(radians(lon)) AS vy, sin(radians(lat)) AS vz FROM {table})",
        f"{n}w AS (SELECT *, vx * nx + vy * ny + vz * nz AS dot FROM {n}v, {n}f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY dot DESC) = 1)",
        f"{n}p AS (SELECT *, (vx * ex + vy * ey + vz * ez) / dot * {fine!r}::DOUBLE AS x0, (vx * gx + vy * gy + vz * gz) / dot * {fine!r}::DOUBLE AS y0 FROM {n}w)",
        f"{n}q AS (SELECT *, {c!r}::DOUBLE * x0 + {s!r}::DOUBLE * y0 AS x, {c!r}::DOUBLE * y0 - {s!r}::DOUBLE * x0 AS y FROM {n}p)",
        f"{n}r AS (SELECT *, x - y * {third!r}::DOUBLE AS t0, y * {2 * third!r}::DOUBLE AS t1, -x - y * {third!r}::DOUBLE AS t2 FROM {n}q)",
        f"{n}s AS (SELECT *, round(t0) AS r0, round(t1) AS r1, round(t2) AS r2, abs(round(t0) - t0) AS o0, abs(round(t1) - t1) AS o1, abs(round(t2) - t2) AS o2 FROM {n}r)",
        f"{n}{res} AS (SELECT *, (CASE WHEN o2 > o0 AND o2 > o1 THEN r0 + r1 ELSE -r2 END)::BIGINT AS a{res}, (CASE WHEN o1 > o0 AND o1 >= o2 THEN -r0 - r2 ELSE r1 END)::BIGINT AS b{res} FROM {n}s)",
    ]
    for r in range(res, 0, -1):
        m, k = hexsphere._PARENT_OF[r % 2 == 1], hexsphere._CENTRE_OF[r % 2 == 1]
        a, b = f"a{r}", f"b{r}"
        out.append(f"{n}u{r} AS (SELECT *, round(({m[0][0]} * {a} + {m[0][1]} * {b}) / 7::DOUBLE)::BIGINT AS a{r - 1}, round(({m[1][0]} * {a} + {m[1][1]} * {b}) / 7::DOUBLE)::BIGINT AS b{r - 1} FROM {n}{r})")
        digits = "[" + ", ".join(map(str, hexsphere._digit_of())) + "]"
        out.append(f"{n}{r - 1} AS (SELECT *, {digits}[({a} - ({k[0][0]}) * a{r - 1} - ({k[0][1]}) * b{r - 1} + 1) * 3 + {b} - ({k[1][0]}) * a{r - 1} - ({k[1][1]}) * b{r - 1} + 2] AS d{r} FROM {n}u{r})")
    lead = "CASE " + " ".join(f"WHEN d{r} > 0 THEN d{r}" for r in range(1, res + 1)) + " ELSE 0 END"
    low = "least(a0, b0, 0)"
    turned = "[" + ", ".join(map(str, hexsphere._TURNED)) + "]"
    total = " + ".join(f"{turned}[turn * 7 + d{r} + 1]::BIGINT * {1 << 3 * (15 - r)}" for r in range(1, res + 1))
    head = (1 << 59) | (res << 52) | ((1 << 3 * (15 - res)) - 1)
    out += [
        f"{n}k(k, packed) AS (VALUES {rows})",
        f"{n}j AS (SELECT *, {lead} AS lead FROM {n}0 JOIN {n}k ON k = face * 27 + (a0 - {low}) * 9 + (b0 - {low}) * 3 - {low})",
        f"{n}l AS (SELECT *, (packed >> (7 + 3 * lead)) & 7 AS turn FROM {n}j)",
        f"{name} AS (SELECT *, {head} + (packed & 127) * {1 << 45} + {total} AS sid FROM {n}l)",
    ]
    return ",\n".join(out)


CELLS = f"{sql.LENS}, {cells_sql('lens', RES, 'sph')}"


def _pings(s, d) -> DataFrame:
    return lens.pings(s, d).withColumn("sid", HexSphere(RES).cell(F.col("lat"), F.col("lon")))


@query("SELECT event_id, lower(to_hex(sid)) AS cell FROM sph", CELLS)
def sphere_cells(s, d):
    return _pings(s, d).select("event_id", HexSphere.name(F.col("sid")).alias("cell"))


@query("SELECT lower(to_hex(sid)) AS cell, count(*) AS n, round(avg(sog) FILTER (WHERE sog > 0.5::DOUBLE), 4) AS mean_sog FROM sph GROUP BY sid", CELLS)
def sphere_traffic(s, d):
    """Speeds are added up as decimals, so that their mean, often half-way between two roundings, doesn't depend on the order of rows."""
    sog = F.when(F.col("sog") > 0.5, F.col("sog"))
    mean = F.sum(sog.cast("decimal(28,12)")).cast("double") / F.count(sog)
    # rounded as the SQL does it: half away from zero, of the product
    return _pings(s, d).groupBy("sid").agg(F.count("*").alias("n"), (F.round(mean * 10000) / 10000).alias("mean_sog")).select(HexSphere.name(F.col("sid")).alias("cell"), "n", "mean_sog")


_CUT = lambda res: (~((15 << 52) | ((1 << 3 * (15 - res)) - 1)), (res << 52) | ((1 << 3 * (15 - res)) - 1))


@query(f"SELECT lower(to_hex((sid & ({_CUT(5)[0]})) | {_CUT(5)[1]})) AS cell, count(DISTINCT sid) AS n_cells, count(*) AS n FROM sph GROUP BY 1", CELLS)
def sphere_parents(s, d):
    parent = HexSphere(RES).parent(F.col("sid"), 5)
    return _pings(s, d).groupBy(HexSphere.name(parent).alias("cell")).agg(F.count_distinct("sid").alias("n_cells"), F.count("*").alias("n"))


@query("SELECT count(*) AS arrivals, count(DISTINCT sid) AS n_cells FROM sph JOIN entry USING (event_id) WHERE entry", f"{sql.ENTRY}, {cells_sql('lens', RES, 'sph')}")
def sphere_arrivals(s, d):
    """Arrivals in the port, and the cells of the sphere in which they happen."""
    from wakeline.plans.queries import _inside, _silver

    entered = track.entries(_inside(_silver(s, d))).where("entry")
    return entered.agg(F.count("*").alias("arrivals"), F.count_distinct(HexSphere(RES).cell(F.col("lat"), F.col("lon"))).alias("n_cells"))


_FIRST = "first_ping AS (SELECT mmsi AS polygon, lat AS y, lon AS x FROM lens QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY sec, event_id) = 1)"


@query(
    "SELECT polygon, count(*) AS n, sum(event_id)::BIGINT AS ids FROM lens JOIN first_ping ON lon >= x - 0.02::DOUBLE AND lon < x + 0.02::DOUBLE AND lat >= y - 0.01::DOUBLE AND lat < y + 0.01::DOUBLE GROUP BY 1",
    f"{sql.LENS}, {_FIRST}",
)
def pings_near_starts(s, d):
    """Pings of all vessels in a box around each vessel's first ping: as many polygons as there are first positions, by their cells.

    Pings at one position are counted before, and vessels that begin at one position share a box, so no pair of rows is made twice.
    """
    p = lens.pings(s, d)
    first = saved(p.withColumn("k", F.row_number().over(Window.partitionBy("mmsi").orderBy("sec", "event_id"))).where("k = 1").select("mmsi", "lat", "lon"), "firsts")
    begins = saved(first.select("lat", "lon").distinct().withColumn("box", F.monotonically_increasing_id()), "boxes")
    lat, lon = F.col("lat"), F.col("lon")
    boxes = polygons.box_polygons(begins, "box", lon - F.lit(0.02), lat - F.lit(0.01), lon + F.lit(0.02), lat + F.lit(0.01))
    points = p.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    hits = polygons.within(points, polygons.cover(boxes, RES), RES).groupBy(F.col("polygon").alias("box")).agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    return first.join(begins.join(hits, "box"), ["lat", "lon"]).select(F.col("mmsi").alias("polygon"), "n", "ids")


PORT_CELLS = f"""{sql.SILVER}, moored AS (SELECT * FROM silver WHERE sog < 1 AND lon BETWEEN {lens.PORT[0]} AND {lens.PORT[2]} AND lat BETWEEN {lens.PORT[1]} AND {lens.PORT[3]}),
{cells_sql("moored", PORT_RES, "mo")}, cnt AS (SELECT sid AS cell, count(*) AS n FROM mo GROUP BY 1),
kept AS (SELECT cell, n FROM (SELECT *, sum(n) OVER (ORDER BY n DESC, cell) - n AS before, sum(n) OVER () AS total FROM cnt) WHERE before < 0.9::DOUBLE * total)"""


def _port(s, d) -> DataFrame:
    """Busiest cells of the sphere with 90 % of the moored pings in the port's zone."""
    zone = (F.col("sog") < 1.0) & F.col("lon").between(lens.PORT[0], lens.PORT[2]) & F.col("lat").between(lens.PORT[1], lens.PORT[3])
    moored = track.silver(lens.pings(s, d), lens.BOX).where(zone)
    counts = moored.groupBy(HexSphere(PORT_RES).cell(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count("*").alias("n"))
    return ranked.busiest(counts, 0.9)


@query("SELECT lower(to_hex(cell)) AS cell, n FROM kept", PORT_CELLS)
def port_cells(s, d):
    return _port(s, d).select(HexSphere.name(F.col("cell")).alias("cell"), "n")


@query()
def port_rings(s, d):
    """The port's cells dissolved into closed rings; a hole has a negative area and its outer ring's name."""
    found = polygons.rings(polygons.outline(_port(s, d), HexSphere(PORT_RES)))
    return found.select("ring", "outer", F.round("area", 9).alias("area"), (F.size("points") - 1).alias("corners"))


@query("SELECT event_id, sid IN (SELECT cell FROM kept) AS inside FROM pi", f"{PORT_CELLS}, {cells_sql('lens', PORT_RES, 'pi')}")
def port_inside(s, d):
    """Pings in the port's polygon, which is dissolved, written as GeoJSON, read again and covered; the cells say the same."""
    path = files.scratch(s, "port")
    geojson.write_rings(polygons.rings(polygons.outline(_port(s, d), HexSphere(PORT_RES))), path)
    edges = geojson.read_polygons(s, path).select(F.lit("port").alias("polygon"), "x1", "y1", "x2", "y2")
    p = lens.pings(s, d).select("event_id", "lat", "lon")
    hits = polygons.within(p, polygons.cover(edges, PORT_RES), PORT_RES).select("event_id", F.lit(True).alias("hit"))
    return p.join(hits, "event_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("inside"))


# --- a vessel with half of all pings, in slices of time

HALF = f"{lens.SQL.strip().replace('lens AS', 'lens0 AS', 1)}, lens AS (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 200000000 ELSE mmsi END AS mmsi) FROM lens0)"
_half = lambda text: text.replace(lens.SQL.strip(), HALF)
#: Slices that the busiest vessel is cut into, about half as many as this.
SLICES = 100


def _sliced(s, d) -> DataFrame:
    p = lens.pings(s, d).withColumn("mmsi", F.when(F.col("event_id") % 2 == 0, F.lit(200000000).cast("long")).otherwise(F.col("mmsi")))
    return sliced.sliced(p, max(1, p.count() // SLICES))


def _sliced_silver(s, d) -> DataFrame:
    return track.without_jumps(sliced.segments(sliced.deduplicated(track.without_sentinels(track.clip(_sliced(s, d), *lens.BOX)))))


def _sliced_eta(s, d) -> DataFrame:
    from wakeline.plans.queries import _inside

    return track.eta_label(sliced.next_arrival(sliced.entries(_inside(_sliced_silver(s, d)))))


@query("SELECT event_id, dt_s, round(dist_km, 4) AS dist_km, gap_flag FROM silver", _half(sql.SILVER))
def sliced_segments(s, d):
    """Segments where one vessel has half of all pings; its track is spread over many tasks."""
    return _sliced_silver(s, d).select("event_id", "dt_s", R4("dist_km").alias("dist_km"), "gap_flag")


@query("SELECT event_id, arrival, round(eta_min, 4) AS eta_min, has_eta FROM eta", _half(sql.ETA))
def sliced_arrivals(s, d):
    return _sliced_eta(s, d).select("event_id", "arrival", R4("eta_min").alias("eta_min"), "has_eta")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest FROM lens", _half(sql.LENS))
def sliced_last_known(s, d):
    return sliced.last_known(_sliced(s, d), F.when(F.col("event_type") == "signup", F.col("event_id")), "latest").select("event_id", "latest")


@query(
    "SELECT event_id, round(km, 3) AS km FROM (SELECT event_id, has_eta, sum(dist_km) OVER w AS km, count(*) OVER w AS k FROM eta WINDOW w AS (PARTITION BY mmsi ORDER BY sec, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) WHERE k = 16 AND has_eta",
    _half(sql.ETA),
)
def sliced_sequences(s, d):
    found = sliced.sequences(_sliced_eta(s, d), ["dist_km"])
    return found.select("event_id", F.round(F.aggregate("steps", F.lit(0.0), lambda a, v: a + v["dist_km"]), 3).alias("km"))


# --- archives


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, round(sum(value), 2) AS total FROM events GROUP BY 1", "one AS (SELECT 1)")
def archive_members(s, d):
    """Events by way of zipped CSV files, a member for each task that writes and for each that reads."""
    path = files.scratch(s, "archives")
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value").repartition(5)
    archives.write_csv(e, path).agg(F.sum("n")).first()
    rows = archives.read_csv(s, path, "event_id long, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 2).alias("total"))


# --- moving windows


def _moving(s, d) -> DataFrame:
    """Windows of 30 days from day summaries that were brought up to date twice, each time from new days alone."""
    source, path = files.scratch(s, "days"), files.scratch(s, "summaries")
    p = lens.pings(s, d).select("mmsi", "sog", F.floor(F.col("sec") / 86400).cast("int").alias("day"))
    middle = F.expr("(min(day) + max(day)) div 2")
    halves = saved(p.crossJoin(F.broadcast(p.agg(middle.alias("middle")))), "halves")
    for half in ("day <= middle", "day > middle"):
        part = halves.where(half).drop("middle")
        part.repartition("day").write.mode("append").partitionBy("day").parquet(source)
        moving.refresh(s, source, path)
    return moving.windows(s.read.parquet(path))


@query("SELECT day, count(*) AS n, round(sum(sog), 3) AS total FROM (SELECT DISTINCT (sec // 86400)::INTEGER AS day FROM lens) d JOIN lens ON (sec // 86400)::INTEGER BETWEEN day - 29 AND day GROUP BY 1")
def moving_sums(s, d):
    return _moving(s, d).select("day", "n", F.round("total", 3).alias("total"))


@query()
def moving_sketches(s, d):
    """Distinct vessels and quantiles of speed over 30 days; the bounds of their errors are tested against exact ones."""
    return _moving(s, d).select("day", moving.distinct().alias("n_vessels"), *(moving.quantile(q).alias(f"p{int(q * 100)}") for q in (0.05, 0.5, 0.95)))


# --- timers


@query("SELECT mmsi, prev AS t_start, sec AS t_end FROM (SELECT mmsi, sec, lag(sec) OVER (PARTITION BY mmsi ORDER BY sec, event_id) AS prev FROM lens) WHERE sec - prev > 1800")
def stream_silences(s, d):
    """The silences that have an end, of a stream that also tells open ones by timers, over two batches in time's order."""
    path, files_each, store = files.scratch(s, "pings"), 4, s.conf.get("spark.sql.streaming.stateStore.providerClass")
    p = lens.pings(s, d).select("mmsi", "sec", F.timestamp_seconds("sec").alias("at"))
    halves = p.crossJoin(F.broadcast(p.agg(F.expr("min(sec) + (max(sec) - min(sec)) div 2").alias("middle"))))
    for half in ("sec <= middle", "sec > middle"):
        halves.where(half).drop("middle").repartition(files_each).write.mode("append").parquet(path)
    stream = s.readStream.schema("mmsi long, sec long, at timestamp").option("maxFilesPerTrigger", files_each).parquet(path)
    timers.with_timers(s)
    try:
        told = live.landed(timers.silences(stream, "at", "1 minute", track.GAP_S, 3650 * 86400), "silences")
    finally:
        s.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    return told.where("t_end IS NOT NULL")

"""DuckDB text of the stages, to check the Spark ones against."""

from __future__ import annotations

import math

from wakeline.plans.lens import BOX, POINT, PORT
from wakeline.plans.lens import SQL as LENS

X1, Y1, X2, Y2 = BOX


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    # not least(1, ...): it skips NULL, and a first ping's distance would be half the way round the earth
    return f"(12742.0176::DOUBLE * asin(CASE WHEN {h} > 1 THEN 1 ELSE sqrt({h}) END))"


KN = lambda km, s: f"CASE WHEN {s} > 0 THEN {km} / ({s} / 3600::DOUBLE) / 1.852::DOUBLE END"
CLIP = f"{LENS}, clip AS (SELECT * FROM lens WHERE lon BETWEEN {X1} AND {X2} AND lat BETWEEN {Y1} AND {Y2} AND mmsi IS NOT NULL AND sec IS NOT NULL)"
NULLED = f"{CLIP}, nulled AS (SELECT * REPLACE (nullif(sog, 102.3::DOUBLE) AS sog, nullif(cog, 360::DOUBLE) AS cog, nullif(heading, 511::DOUBLE) AS heading) FROM clip)"
DEDUP = f"{NULLED}, dedup AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, sec ORDER BY lat, lon, event_id) AS rn FROM nulled) WHERE rn = 1)"
SEG = f"""{DEDUP}, pre AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(sec) OVER w AS sec0 FROM dedup WINDOW w AS (PARTITION BY mmsi ORDER BY sec, event_id)),
seg0 AS (SELECT *, sec - sec0 AS dt_s, coalesce({hav("lat0", "lon0", "lat", "lon")}, 0) AS dist_km FROM pre), seg AS (SELECT *, {KN("dist_km", "dt_s")} AS implied_kn, dt_s > 1800 AS gap_flag FROM seg0)"""
SILVER = f"{SEG}, silver AS (SELECT * FROM seg WHERE implied_kn IS NULL OR implied_kn <= 60)"
GX, GY, GX2, GY2 = PORT
EDGE, KLON = 1.4, 111.32 * math.cos(math.radians(33.7))
XY = f"((lon - (-118.2)) * {KLON!r}::DOUBLE)", "((lat - 33.7) * 110.57::DOUBLE)"


def hexed(table: str, edge: str = "1.4") -> str:
    """The table with its cells on the grid of that edge."""
    q = f"({math.sqrt(3) / 3!r}::DOUBLE * {XY[0]} - {XY[1]} / 3) / {edge}::DOUBLE"
    r = f"({2.0 / 3.0!r}::DOUBLE * {XY[1]}) / {edge}::DOUBLE"
    return f"""SELECT *, (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::INTEGER::VARCHAR || ':' || (CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END)::INTEGER::VARCHAR AS cell
FROM (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM (SELECT *, round(q) AS rq, round(r) AS rr, round(s) AS rs FROM (SELECT *, -q - r AS s FROM (
SELECT *, {q} AS q, {r} AS r FROM {table}))))"""


HEX = hexed("%s")
PIP = f"(lat > {GY} AND lat < {GY2} AND lon > {GX} AND lon < {GX2})"
INSIDE = f"{SILVER}, ins AS (SELECT *, {PIP} AS inside FROM silver)"
ENTRY = f"{INSIDE}, entry AS (SELECT *, inside AND NOT lag(inside, 1, false) OVER (PARTITION BY mmsi ORDER BY sec, event_id) AS entry FROM ins)"
ASOF = f"{ENTRY}, arr AS (SELECT mmsi AS m, sec AS a FROM entry WHERE entry), reach AS (SELECT entry.*, arr.a AS arrival FROM entry ASOF LEFT JOIN arr ON arr.m = entry.mmsi AND arr.a >= entry.sec)"
ETA = f"{ASOF}, eta AS (SELECT *, coalesce(eta_min BETWEEN 0 AND 720 AND NOT inside, false) AS has_eta FROM (SELECT *, (arrival - sec) / 60::DOUBLE AS eta_min FROM reach))"
DIST = hav("lat", "lon", str(POINT[0]), str(POINT[1]))
BEAR = f"""((degrees(atan2(sin(radians({POINT[1]}::DOUBLE) - radians(lon)) * cos(radians({POINT[0]}::DOUBLE)), cos(radians(lat)) * sin(radians({POINT[0]}::DOUBLE)) - sin(radians(lat)) * cos(radians({POINT[0]}::DOUBLE)) * cos(radians({POINT[1]}::DOUBLE) - radians(lon)))) + 360) % 360)"""


def gaps_of(table: str) -> str:
    return f"""gp AS (SELECT *, lag(sec) OVER w AS t_start, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(sog) OVER w AS sog_before FROM {table} WHERE mmsi > 99999999 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 WINDOW w AS (PARTITION BY mmsi ORDER BY sec, event_id)),
gaps AS (SELECT event_id, mmsi, t_start, sec AS t_end, (sec - t_start) / 3600::DOUBLE AS gap_h, {hav("lat0", "lon0", "lat", "lon")} AS dist_km, sog_before, lat0, lon0, lat AS lat1, lon AS lon1, floor(t_start % 86400 / 3600)::INTEGER AS hour0 FROM gp WHERE sec - t_start > 1800),
dark AS (SELECT *, coalesce(gap_h >= 2 AND sog_before >= 3 AND dist_km >= 5 AND implied_kn BETWEEN 1 AND 40, false) AS rule_flag FROM (SELECT *, {KN("dist_km", "(gap_h * 3600)")} AS implied_kn FROM gaps) WHERE implied_kn <= 60 AND dist_km >= 0)"""


GAPS = f"{LENS}, {gaps_of('lens')}"

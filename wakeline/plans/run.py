"""The whole way of a snapshot: ingest to Bronze, Silver, Gold, dark events and the arrival model, each with a manifest.

    python -m wakeline.plans.run --config CONFIG --snapshot NAME [--skip-ingest] [--no-model] [--res 7] [--horizon-min 720]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions.hexsphere import HexSphere
from wakeline.ml import eta, forest
from wakeline.operators import track
from wakeline.plans import lens
from wakeline.sources import archives, files, landing

FEATURES = ["gap_h", "dist_km", "implied_kn", "sog_before", "hour0", "abs_lat"]
#: Columns of the published daily files that are typed; the others stay text.
CSV = (
    "MMSI long, BaseDateTime timestamp_ntz, LAT double, LON double, SOG double, COG double, Heading double, VesselName string, IMO string, CallSign string, "
    "VesselType string, Status string, Length double, Width double, Draft double, Cargo string, TransceiverClass string"
)
#: Resolution of Gold's cells and the furthest arrival that is a label.
RES, HORIZON_MIN = 7, 720.0


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """Pings from zipped daily files: a task for each archive's member. event_id is a hash of the row, to order equal times."""
    rows = archives.read_csv(spark, path, CSV)
    sec = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', BaseDateTime)")
    named = {"mmsi": F.col("MMSI"), "sec": sec, "lat": F.col("LAT"), "lon": F.col("LON"), "sog": F.col("SOG"), "cog": F.col("COG"), "heading": F.col("Heading")}
    more = ("VesselName", "IMO", "CallSign", "VesselType", "Status", "Length", "Width", "Draft")
    return rows.select(F.xxhash64(*rows.columns).alias("event_id"), *(c.alias(n) for n, c in named.items()), *more)


def run(spark: SparkSession, config: str, name: str, pings: DataFrame | None = None, skip_ingest: bool = False, model: bool = False, res: int = RES, horizon_min: float = HORIZON_MIN) -> dict[str, int]:
    """Writes the snapshot's tables under the configured folder; rows by table.

    Bronze is made from pings, or from the archives under the snapshot's `archives`; with skip_ingest it is what an earlier run
    wrote. Each step reads what the step before it wrote, so a run that broke off is begun again with what is there
    overwritten. Without a bounding box nothing is clipped. Manifests hold each file's size and digest. With model, one is
    trained if there are sequences of training vessels; `report` has its errors and the naive ones by split.
    """
    cfg = landing.config(config)
    of = landing.snapshot(cfg, name)
    box = of.get("bbox")
    corners = (box["lon_min"], box["lat_min"], box["lon_max"], box["lat_max"]) if box else (-180.0, -90.0, 180.0, 90.0)
    root = cfg["folder"].rstrip("/")
    done: dict[str, int] = {}

    def step(table: str, rows: DataFrame) -> DataFrame:
        path = f"{root}/{table}/snapshot={name}"
        done[table] = files.ingest(rows, path)
        stamped = landing.manifest(spark, path).where("name LIKE '%.parquet'").withColumn("made", F.lit(landing.stamp()))
        stamped.coalesce(1).write.mode("overwrite").json(f"{root}/manifest/snapshot={name}/{table}")
        return spark.read.parquet(path)

    bronze = spark.read.parquet(f"{root}/bronze/snapshot={name}") if skip_ingest else step("bronze", ingest(spark, of["archives"]) if pings is None else pings)
    silver = step("silver", track.silver(bronze, corners))
    inside = silver.withColumn("inside", geo.in_rings(F.col("lat"), F.col("lon"), geo.box_edges(*lens.PORT)))
    at = F.col("lat"), F.col("lon"), F.lit(lens.POINT[0]), F.lit(lens.POINT[1])
    cell = HexSphere.name(HexSphere(res).cell(*at[:2]))
    labelled = track.eta_label(track.next_arrival(track.entries(inside)), horizon_min)
    gold = step("gold", labelled.withColumns({"cell": cell, "port_km": geo.haversine_km(*at), "port_deg": geo.bearing_deg(*at)}))
    path = files.scratch(spark, "gaps")
    track.dark_candidates(track.gaps(bronze)).withColumn("abs_lat", F.abs("lat0")).write.parquet(path)
    scored = forest.scored(spark.read.parquet(path), FEATURES, F.col("event_id"))
    step("dark", scored.where(F.col("rule_flag") | F.col("iso_anomaly")))
    if model:
        rows = step("sequences", eta.sequences(gold))
        if not rows.where("split = 'train'").isEmpty():
            trees = eta.train(rows)
            eta.save(trees, eta.scaler(rows), f"{root}/model/snapshot={name}")
            step("report", eta.report(rows, trees))
    return done


def main(argv: list[str] | None = None) -> dict[str, int]:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--config", required=True, help="YAML with folder and snapshots")
    p.add_argument("--snapshot", required=True, help="a snapshot of the configuration")
    p.add_argument("--skip-ingest", action="store_true", help="go on from the Bronze that is there")
    p.add_argument("--no-model", action="store_true", help="stop before the arrival model")
    p.add_argument("--res", type=int, default=RES, help="resolution of Gold's cells, 0 to 15")
    p.add_argument("--horizon-min", type=float, default=HORIZON_MIN, help="furthest arrival in minutes that is a label")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("wakeline").getOrCreate()
    done = run(spark, a.config, a.snapshot, skip_ingest=a.skip_ingest, model=not a.no_model, res=a.res, horizon_min=a.horizon_min)
    for table, n in done.items():
        print(f"{table}: {n} rows")
    return done


if __name__ == "__main__":
    main()

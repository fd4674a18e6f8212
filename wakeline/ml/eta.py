"""Arrival-time model on sequences of pings: features, split by vessel, scaler, boosted trees, baselines."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import scalar
from wakeline.operators import track

# fixed values: steps, continuous features, angles
STEPS = 16
CONTINUOUS, ANGLES = ("sog", "port_km", "dt_s", "dist_km"), ("cog", "heading", "port_deg")
FEATURES = (*CONTINUOUS, *(f"{f}_{a}" for a in ANGLES for f in ("cos", "sin")))
MODEL_SEED = 42


def featured(df: DataFrame) -> DataFrame:
    """Adds the ten features: four continuous ones with null as 0, and cosine and sine of three angles."""
    angles = {f"{n}_{a}": c for a in ANGLES for n, c in zip(("cos", "sin"), scalar.angle(F.col(a)), strict=True)}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in CONTINUOUS} | angles)


def sequences(df: DataFrame, k: int = STEPS) -> DataFrame:
    """Labelled pings with their last k pings' features (steps), the log target (y) and the vessel's split."""
    rows = track.sequences(featured(df), list(FEATURES), k)
    return rows.withColumns({"y": F.log1p("eta_min"), "split": scalar.split_name(scalar.md5_bucket(F.col("mmsi")))})


def skipped(df: DataFrame, k: int = STEPS) -> DataFrame:
    """(n): labels of vessels with fewer than k pings, which have no sequence."""
    by = df.groupBy("mmsi").agg(F.count("*").alias("pings"), F.count_if("has_eta").alias("labels"))
    return by.agg(F.coalesce(F.sum(F.when(F.col("pings") < k, F.col("labels"))), F.lit(0)).alias("n"))


def scaler(rows: DataFrame) -> DataFrame:
    """(feature, mean, std): over all steps of all training sequences; the deviation is the population's plus 1e-6."""
    steps = rows.where("split = 'train'").select(F.explode("steps").alias("s"))
    pairs = steps.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"s.{c}").alias("v")) for c in CONTINUOUS))))
    return pairs.groupBy("feature").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + 1e-6).alias("std"))


def standardized(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows with the continuous features of each step scaled; stats has four rows."""
    one = stats.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_s"))

    def scale(step: Column) -> Column:
        z = [((step[c] - F.col("_s")[c]["mean"]) / F.col("_s")[c]["std"]).alias(c) for c in CONTINUOUS]
        return F.struct(*z, *(step[c].alias(c) for c in FEATURES if c not in CONTINUOUS))

    return rows.crossJoin(F.broadcast(one)).withColumn("steps", F.transform("steps", scale)).drop("_s")


def naive_minutes() -> Column:
    """Distance over the present speed, at least half a knot."""
    return F.col("port_km") / (F.greatest(F.col("sog"), F.lit(0.5)) * 1.852) * 60.0


def mae(guess: Column, truth: Column) -> Column:
    """Mean absolute error in minutes of log minutes."""
    return F.avg(F.abs(F.expm1(guess) - F.expm1(truth)))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)


def train(rows: DataFrame, iterations: int = 20, depth: int = 5) -> GBTRegressionModel:
    """Boosted trees on the last ping of the training sequences, raw features, log target."""
    return GBTRegressor(featuresCol="x", labelCol="y", maxIter=iterations, maxDepth=depth, seed=MODEL_SEED).fit(_vectors(rows.where("split = 'train'")))


def predicted(rows: DataFrame, model: GBTRegressionModel) -> DataFrame:
    return model.transform(_vectors(rows)).drop("x")


def report(rows: DataFrame, model: GBTRegressionModel) -> DataFrame:
    """(split, n, naive, trees): errors in minutes by split."""
    minutes = F.log1p(naive_minutes())
    return predicted(rows, model).groupBy("split").agg(F.count("*").alias("n"), mae(minutes, F.col("y")).alias("naive"), mae(F.col("prediction"), F.col("y")).alias("trees"))


def save(model: GBTRegressionModel, stats: DataFrame, folder: str) -> None:
    """The model, the scaler and what they were made of, as files of Spark's own writers."""
    model.write().overwrite().save(f"{folder}/model")
    stats.coalesce(1).write.mode("overwrite").json(f"{folder}/scaler")
    meta = [(list(FEATURES), list(CONTINUOUS), STEPS, "log1p(eta_min)")]
    stats.sparkSession.createDataFrame(meta, "features array<string>, continuous array<string>, steps int, target string").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def load(folder: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(f"{folder}/model")

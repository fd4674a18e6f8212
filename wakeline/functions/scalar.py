"""Deterministic splits, samples, encodings and styling, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def md5_bucket(key: Column, buckets: int = 100) -> Column:
    """The MD5 of key's text as one whole number, modulo buckets, by four parts of eight hex digits."""
    digest, step = F.md5(key.cast("string").cast("binary")), (1 << 32) % buckets
    part = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    out = part(0) % buckets
    for i in (1, 2, 3):
        out = (out * step + part(i)) % buckets
    return out


def split_name(bucket: Column) -> Column:
    return F.when(bucket < 70, "train").when(bucket < 85, "val").otherwise("test")


def sample_key(seed: int, key: Column) -> Column:
    """An order that looks random and is the same in every run."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")).cast("binary"))


def angle(deg: Column) -> tuple[Column, Column]:
    """Cosine and sine of an angle in degrees; null counts as 0."""
    a = F.radians(F.coalesce(deg, F.lit(0.0)))
    return F.cos(a), F.sin(a)


def identity(*parts: Column) -> Column:
    """Parts joined by |, null as empty (concat_ws would drop its separator)."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    out = text[0]
    for p in text[1:]:
        out = F.concat(out, F.lit("|"), p)
    return out


def shade(x: Column, low: float, high: float) -> Column:
    """A step of 0 to 255 between two bounds, clipped; null and NaN are the lowest."""
    v = F.coalesce(F.nanvl(x, F.lit(low)), F.lit(low))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low))) * 255.0).cast("int")


def rgba(step: Column, alpha: int) -> tuple[Column, ...]:
    """Red, green, blue and alpha of a step of 0 to 255: three ramps that rise and fall one after the other."""
    x = step / 255.0
    ramp = lambda at: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((1.5 - F.abs(4 * x - at)) * 255))).cast("int")
    return ramp(3), ramp(2), ramp(1), F.lit(alpha)


def styled(df: DataFrame) -> DataFrame:
    """Adds r, radius and label by the column dark; a table without it is of plain detections."""
    if "dark" not in df.columns:
        return df.withColumns({"r": F.lit(255), "radius": F.lit(900), "label": F.lit("detection")})
    pick = lambda a, b: F.when(F.col("dark"), F.lit(a)).otherwise(F.lit(b))
    return df.withColumns({"r": pick(255, 60), "radius": pick(900, 500), "label": pick("dark", "seen")})


def agreement(results: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(agree, off) of summaries (n_vessels, n_points, km): equal counts and close kilometres; off counts what differs."""
    one = results.agg(F.count_distinct("n_vessels").alias("v"), F.count_distinct("n_points").alias("p"), F.min("km").alias("low"), F.max("km").alias("high"))
    close = F.coalesce(F.try_divide(F.col("high") - F.col("low"), F.col("high")) < tolerance, F.lit(True))
    off = sum((c.cast("long") for c in (F.col("v") > 1, F.col("p") > 1, ~close)), F.lit(0).cast("long"))
    return one.select((off == 0).alias("agree"), off.alias("off"))

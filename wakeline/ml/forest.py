"""Isolation forest (Liu, Ting and Zhou, 2008): trees on small samples, scores on all rows.

The trees see at most `trees` x `sample` rows, taken in a fixed pseudo-random order, which bounds what comes
to the driver and what goes to the tasks. The share of anomalies is cut at an exact quantile of the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wakeline.operators import ranked
from wakeline.sources.files import scratch

# fixed values: trees, rows a tree sees, share of anomalies, seed
TREES, SAMPLE, SHARE, SEED = 200, 256, 0.02, 42
_EULER = 0.5772156649015329


def path_length(n: float) -> float:
    """Mean length of an unsuccessful search among n rows: what a leaf of n rows still hides."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + _EULER) - 2 * (n - 1) / n


class Forest:
    """Trees as flat arrays: feature (-1 for a leaf), cut, children, and the depth that a leaf stands for."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(rows))
        limit = math.ceil(math.log2(max(2, self.size)))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], limit, rng) for _ in range(trees)] if len(rows) else []

    @staticmethod
    def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, depth = [], [], [], [], []
        todo = [(np.arange(len(x)), 0, -1, 0)]  # rows, depth, parent, side
        while todo:
            rows, d, parent, side = todo.pop()
            me = len(feature)
            if parent >= 0:
                (right if side else left)[parent] = me
            low, high = x[rows].min(0), x[rows].max(0)
            wide = np.flatnonzero(high > low)
            if d >= limit or len(rows) < 2 or not len(wide):
                for a, v in zip((feature, cut, left, right, depth), (-1, 0.0, me, me, d + path_length(len(rows))), strict=True):
                    a.append(v)
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(low[f], high[f])
            for a, v in zip((feature, cut, left, right, depth), (f, at, me, me, 0.0), strict=True):
                a.append(v)
            below = x[rows, f] < at
            todo += [(rows[below], d + 1, me, 0), (rows[~below], d + 1, me, 1)]
        return tuple(np.array(a) for a in (feature, cut, left, right, depth))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean depth / expected depth): near 1 for what few cuts isolate."""
        total = np.zeros(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                below = x[np.arange(len(x)), np.maximum(feature[at], 0)] < cut[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            total += depth[at]
        return 2.0 ** (-(total / max(1, len(self.trees))) / max(1.0, path_length(self.size)))


def _matrix(b: pa.RecordBatch, features: list[str]) -> np.ndarray:
    cols = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features]
    return np.nan_to_num(np.stack(cols, 1) if cols else np.zeros((len(b), 0)), nan=0.0)


def scored(df: DataFrame, features: list[str], key: Column, trees: int = TREES, sample: int = SAMPLE, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """df with iso_score (higher: odder) and iso_anomaly (the oddest `share` of the rows).

    key orders the rows for the sample; null and NaN features count as 0. No rows give no rows.
    """
    flat = df.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})
    names = [f"_f{i}" for i in range(len(features))]
    rows = flat.select(*names).orderBy(F.md5(F.concat(F.lit(str(seed)), key.cast("string")).cast("binary"))).limit(trees * sample).toArrow()
    forest = Forest(np.nan_to_num(np.stack([rows.column(c).to_numpy() for c in names], 1), nan=0.0), trees, sample, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.drop_columns(names).columns, pa.array(forest.score(_matrix(b, names)))], [*(n for n in b.schema.names if n not in names), "iso_score"])

    schema = StructType([*df.schema.fields, StructField("iso_score", DoubleType())])
    # written, as the threshold reads all scores before any row is judged
    path = scratch(df.sparkSession, "scores")
    flat.mapInArrow(run, schema).write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    least = ranked.quantiles(out, "iso_score", [1 - share]).select(F.col("value").alias("_least"))
    return out.crossJoin(F.broadcast(least)).withColumn("iso_anomaly", F.col("iso_score") > F.col("_least")).drop("_least")

"""Moving windows from day summaries: exact sums, errors of the sketches within their bounds, only new days read."""

import bisect
import random
import shutil

from oracle_check import differences
from pyspark.sql import functions as F

from wakeline.operators import moving
from wakeline.plans import places, queries  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"


def test_sums_as_sql(spark):
    assert differences(queries.QUERIES["moving_sums"](spark, SF), queries.ORACLE["moving_sums"], SF) == ""
    assert queries.QUERIES["moving_sketches"](spark, SF).count() == queries.QUERIES["moving_sums"](spark, SF).count()


def test_sketches_within_their_bounds(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(3000), None if rng.random() < 0.1 else rng.lognormvariate(0, 1), day) for day in (1, 2, 5, 40, 41, 90) for _ in range(4000)] + [(None, None, 91)]
    source, path = f"file://{tmp_path}/source", f"file://{tmp_path}/sketches"
    df = spark.createDataFrame(rows, "mmsi long, sog double, day int")
    df.where("day < 41").write.partitionBy("day").parquet(source)
    assert moving.refresh(spark, source, path) == [1, 2, 5, 40] and moving.refresh(spark, source, path) == []
    df.where("day >= 41").write.mode("append").partitionBy("day").parquet(source)
    # an old day's rows may be gone: its summary stays
    shutil.rmtree(f"{tmp_path}/source/day=5")
    assert moving.refresh(spark, source, path) == [41, 90, 91]
    got = {r["day"]: r for r in moving.windows(spark.read.parquet(path)).select("day", "n", "total", moving.distinct().alias("keys"), *(moving.quantile(q).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95))).collect()}
    assert sorted(got) == [1, 2, 5, 40, 41, 90, 91]
    for day, r in got.items():
        held = [x for x in rows if day - 29 <= x[2] <= day]
        values = sorted(x[1] for x in held if x[1] is not None)
        keys = len({x[0] for x in held} - {None})
        assert r["n"] == len(held) and abs(r["total"] - sum(values)) < 1e-6 and abs(r["keys"] - keys) <= 0.05 * keys
        for q in (0.05, 0.5, 0.95):
            # the share of values up to the estimate
            assert abs(bisect.bisect_right(values, r[f"q{int(q * 100)}"]) / len(values) - q) <= 0.014
    # late rows of a day that has a summary
    spark.createDataFrame([(5, 1.0, 1)], "mmsi long, sog double, day int").write.mode("append").partitionBy("day").parquet(source)
    assert moving.refresh(spark, source, path) == [] and moving.refresh(spark, source, path, redo=(1,)) == [1]
    assert spark.read.parquet(path).where("day = 1").first()["n"] == 4001 and spark.read.parquet(path).agg(F.count("*")).first()[0] == 7


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "mmsi long, sog double, day int").write.parquet(f"file://{tmp_path}/source")
    assert moving.refresh(spark, f"file://{tmp_path}/source", f"file://{tmp_path}/sketches") == []

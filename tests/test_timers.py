"""Silences told while they last, through restarts; late pings; vessels that are forgotten."""

import pandas as pd
import pytest
from oracle_check import differences
from pyspark.sql import functions as F

from wakeline.plans import places, queries  # noqa: F401  registers its queries
from wakeline.streaming import timers

#: Times at the watermark's own begin would be late.
BASE = 1_700_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    yield timers.with_timers(spark)
    spark.conf.set(PROVIDER, before)


def test_silences_by_timers(rocks, tmp_path):
    """Each file is a run of its own that goes on from the checkpoint."""
    spark, src, out, check = rocks, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"

    def put(*rows):
        spark.createDataFrame([(m, BASE + t) for m, t in rows], "mmsi long, sec long").withColumn("at", F.timestamp_seconds("sec")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("mmsi long, sec long, at timestamp").parquet(src)
        found = timers.silences(stream, "at", "10 minutes", 1800, 100_000)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(timers.SILENCES).parquet(out).collect()
        return sorted((r["mmsi"], r["t_start"] - BASE, -1 if r["t_end"] is None else r["t_end"] - BASE) for r in got), sorted((m, t - BASE, told, late) for m, t, told, late in timers.state(spark, check).collect())

    found, held = put((1, 0), (1, 600), (2, 0), (3, 100))
    assert found == [] and held == [(1, 600, False, 0), (2, 0, False, 0), (3, 100, False, 0)]
    # vessel 1 ends its silence itself; those of 2 and 3 are told as the watermark goes past them
    put((1, 10_000), (1, 9_900))
    found, held = put((1, 10_100))
    assert found == [(1, 600, 9_900), (2, 0, -1), (3, 100, -1)]
    assert held == [(1, 10_100, False, 0), (2, 0, True, 0), (3, 100, True, 0)]
    # 2 is heard again: its silence has an end; 1's ping in time for the watermark but older than its last is late
    put((2, 10_200), (1, 9_700))
    found, held = put((1, 10_300))
    assert found == [(1, 600, 9_900), (2, 0, -1), (2, 0, 10_200), (3, 100, -1)]
    assert held == [(1, 10_300, False, 1), (2, 10_200, False, 0), (3, 100, True, 0)]
    # far ahead: 3 is forgotten, 2 is told as silent
    put((1, 105_000))
    found, held = put((1, 105_010))
    assert [h[0] for h in held] == [1, 2] and (2, 10_200, -1) in found
    # a vessel that was forgotten begins anew
    found, held = put((3, 105_020))
    assert not any(f[0] == 3 and f[2] == 105_020 for f in found) and (3, 105_020, False, 0) in held
    assert len(found) == len(set(found))


def test_limits(spark):
    with pytest.raises(ValueError, match="forget_s"):
        timers.silences(spark.range(1), "at", "1 minute", 10, 10)


def test_query_as_sql(spark):
    before = spark.conf.get(PROVIDER)
    assert differences(queries.QUERIES["stream_silences"](spark, "/root/testdata/sf0.001"), queries.ORACLE["stream_silences"], "/root/testdata/sf0.001") == ""
    assert spark.conf.get(PROVIDER) == before


def test_few_messages_to_the_state():
    """A vessel with new pings costs at most one read, one write and a timer that goes and one that comes; no output where nothing is told."""
    calls, timer = [], set()

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return state

        def registerTimer(self, at):
            calls.append("register")
            timer.add(at)

        def deleteTimer(self, at):
            calls.append("delete")
            timer.remove(at)

    state, told = State(), timers.Silences(1800, 100_000)
    told.init(Handle())
    put = lambda *secs: list(told.handleInputRows((1,), iter([pd.DataFrame({"sec": secs})]), None))
    assert put(BASE, BASE + 60) == [] and calls == ["get", "register", "update"]
    assert len(put(BASE + 5000)) == 1 and len(calls) == 7 and timer == {(BASE + 6800) * 1000}
    assert put(BASE + 10) == [] and len(calls) == 9 and state.held == (BASE + 5000, False, 1)

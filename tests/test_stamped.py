"""The stamped sink: no row lost or doubled, whatever step a batch breaks at."""

import glob
import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wakeline.sources import stamped


def names(path):
    return sorted(os.path.basename(f) for f in glob.glob(f"{path}/*.parquet"))


def run(spark, src, out, check, **options):
    stream = spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.format("vessel_stamped").options(path=f"file://{out}", prefix="pos").option("checkpointLocation", f"file://{check}").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(r["id"] for r in spark.read.parquet(f"file://{out}").collect())


def test_restarts_and_repeated_batches(spark, tmp_path):
    spark.dataSource.register(stamped.StampedSink)
    src, out, check = f"file://{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    rows = lambda a, b: spark.range(a, b, 1, 1).select("id", F.concat(F.lit("é"), "id").alias("v"))
    rows(0, 100).write.mode("append").parquet(src)
    rows(100, 150).write.mode("append").parquet(src)
    assert run(spark, src, out, check) == list(range(150))
    first = names(out)
    assert len(first) == 2 and all(re.fullmatch(r"pos-\d{8}T\d{6}Z-00000[01]-00000\.parquet", n) for n in first)
    # the driver dies after the sink's commit and before the query's: the batch runs again
    for name in ("1", ".1.crc"):
        os.remove(f"{check}/commits/{name}")
    assert run(spark, src, out, check) == list(range(150)) and names(out) == first
    # nothing new: no file
    assert run(spark, src, out, check) == list(range(150)) and names(out) == first
    rows(150, 160).write.mode("append").parquet(src)
    assert run(spark, src, out, check) == list(range(160)) and len(names(out)) == 3


@pytest.mark.parametrize("broken_at", ["list", "rename"])
def test_commit_broken_between_its_steps(spark, tmp_path, monkeypatch, broken_at):
    """Broken before the list is in place, nothing is committed; broken while renaming, the next commit finishes it."""
    writer = stamped.StampedWriter({"path": f"file://{tmp_path}/out"})
    batch = lambda *x: pa.RecordBatch.from_pydict({"id": list(x)})
    messages = [writer.write(iter([batch(1, 2)])), writer.write(iter([batch(3)])), writer.write(iter([])), None]
    moved = [0]

    class Breaking:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return getattr(self.store, name)

        def move(self, a, b):
            moved[0] += 1
            if moved[0] == {"list": 1, "rename": 3}[broken_at]:
                raise OSError("broken")
            self.store.move(a, b)

    located = stamped.located
    monkeypatch.setattr(stamped, "located", lambda p: (Breaking(located(p)[0]), located(p)[1]))
    with pytest.raises(OSError, match="broken"):
        writer.commit(messages, 0)
    monkeypatch.setattr(stamped, "located", located)
    assert len(names(f"{tmp_path}/out")) == {"list": 0, "rename": 1}[broken_at]
    again = [writer.write(iter([batch(1, 2)])), writer.write(iter([batch(3)]))]
    writer.commit(again, 0)
    read = lambda: sorted(r["id"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert read() == [1, 2, 3] and len(names(f"{tmp_path}/out")) == 2
    writer.commit([writer.write(iter([batch(1, 2)])), writer.write(iter([batch(3)]))], 0)
    lost = writer.write(iter([batch(9)]))
    writer.abort([lost, None], 1)
    assert read() == [1, 2, 3]

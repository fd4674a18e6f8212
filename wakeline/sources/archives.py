"""Zip archives as a data source with a partition for each member, and hashes of files of any size.

Both open files by way of Arrow's file systems (local and mounted folders, HDFS, S3, GCS), a chunk at a time, so memory doesn't grow
with a file's or a member's size.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20
#: Characters of lines that are handed on at once.
BATCH = 4 << 20
_LINES = pa.schema([("archive", pa.string()), ("member", pa.string()), ("n", pa.int64()), ("line", pa.string())])


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, for paths and URIs as Spark writes them."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class _Member(InputPartition):
    def __init__(self, archive: str, member: str) -> None:
        self.archive, self.member = archive, member


class ArchiveReader(DataSourceReader):
    """Plans from the archives' central directories alone; a task seeks to its member and inflates it as it goes."""

    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("member", "*.csv").lower()
        self.all, self.encoding = options.get("all", "false").lower() == "true", options.get("encoding", "utf-8")

    def partitions(self) -> list[InputPartition]:
        store, path = located(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((x for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".zip")), key=lambda x: x.path):
            with store.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                members = [m for m in z.namelist() if fnmatch.fnmatch(m.lower(), self.pattern)]
            if not members:
                raise ValueError(f"no {self.pattern} in {f.path}")
            out += [_Member(f.path, m) for m in (members if self.all else members[:1])]
        return out

    def read(self, part: _Member | None) -> Iterator[pa.RecordBatch]:
        # without partitions, Spark runs one task of none
        if part is None:
            return
        store, _ = located(self.path)

        def batch(lines: list[str], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.archive] * len(lines)), pa.array([part.member] * len(lines)), pa.array(range(n, n + len(lines)), pa.int64()), pa.array(lines, pa.string())], schema=_LINES)

        with store.open_input_file(part.archive) as raw, zipfile.ZipFile(raw) as z, z.open(part.member) as packed:
            held, size, n = [], 0, 0
            for line in io.TextIOWrapper(packed, self.encoding, newline=""):
                held.append(line.rstrip("\r\n"))
                size += len(line)
                if size >= BATCH:
                    yield batch(held, n)
                    held, size, n = [], 0, n + len(held)
            if held:
                yield batch(held, n)


class ArchiveSource(DataSource):
    """spark.read.format("vessel_archives"): (archive, member, n, line) of the zip archives under a path.

    Options: path, member (a pattern, *.csv by default, in any case), all (true for all members that match; else an archive's
    first), encoding. An archive in which nothing matches fails the scan; a folder without archives has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "vessel_archives"

    def schema(self) -> str:
        return "archive string, member string, n long, line string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """The typed rows of the archives' CSV members, each with a header line; a row that doesn't fit fails."""
    spark.dataSource.register(ArchiveSource)
    lines = spark.read.format("vessel_archives").options(path=path, **options).load().where("n > 0 AND line <> ''")
    how = {"mode": "FAILFAST", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return lines.select(F.from_csv("line", schema, how).alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str) -> DataFrame:
    """Each partition of df as an archive with one CSV member and a header line; (archive, n) of those written.

    Rows are packed as they come. A task that runs again writes the same name again. Values are cast to text by Spark; null is empty.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = located(path)
        store.create_dir(folder, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():05d}", 0
        with store.open_output_stream(f"{folder}/{name}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open(f"{name}.csv", "w", force_zip64=True) as member:
                member.write((",".join(columns) + "\n").encode())
                for b in batches:
                    member.write(b.to_csv(index=False, header=False, lineterminator="\n").encode())
                    n += len(b)
        yield pd.DataFrame({"archive": [f"{name}.zip"], "n": [n]})

    return df.select(*(F.col(c).cast("string").alias(c) for c in columns)).mapInPandas(run, "archive string, n long")


def hashes(files: DataFrame) -> DataFrame:
    """(path) -> (path, sha256): each file read a chunk at a time by the task that has its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in b["path"]:
                store, at = located(path)
                digest = hashlib.sha256()
                with store.open_input_stream(at, buffer_size=CHUNK) as f:
                    while block := f.read(CHUNK):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pd.DataFrame({"path": b["path"], "sha256": out})

    return files.select("path").mapInPandas(run, "path string, sha256 string")

"""Landing of remote files: download, unzip, manifest, configuration, and a report API as a data source."""

from __future__ import annotations

import io
import json
import logging
import os
import time
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wakeline.functions.geo import closed_ring
from wakeline.sources import archives

CHUNK = 1 << 20
AGENT = "wakeline/1"
#: Bytes of a file up to which it is read whole.
WHOLE_BYTES = 256 << 20
#: Lines of a zipped file that are handed on at once.
LINES = 10_000


def download(url: str, dest: str, agent: str = AGENT) -> int:
    """Fetch one url into a local file, a chunk at a time; the bytes written. A half-written file goes."""
    part, size = f"{dest}.part", 0
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent})) as src, open(part, "wb") as out:
            while block := src.read(CHUNK):
                size += out.write(block)
        os.replace(part, dest)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return size


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): the lines of the first .csv member (in any case) of each archive under path.

    Archives go to different tasks, and one is read line by line. An archive without a .csv member fails. Each archive is
    held whole, up to 2 GB; archives.ArchiveSource has a task for each member and no such bound.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((m for m in z.namelist() if m.lower().endswith(".csv")), None)
                    if member is None:
                        raise ValueError(f"no .csv in {name}")
                    with z.open(member) as raw:
                        held, n = [], 0
                        for line in io.TextIOWrapper(raw, "utf-8", newline=""):
                            held.append(line.rstrip("\r\n"))
                            if len(held) == LINES:
                                yield pd.DataFrame({"file": name, "n": range(n, n + len(held)), "line": held})
                                held, n = [], n + len(held)
                        if held:
                            yield pd.DataFrame({"file": name, "n": range(n, n + len(held)), "line": held})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, n long, line string")


def read_zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of zipped CSV files with a header line, typed; a row that doesn't fit fails."""
    lines = zipped_lines(spark, path).where("n > 0 AND line <> ''")
    options = {"mode": "FAILFAST", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return lines.select(F.from_csv("line", schema, options).alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(name, bytes, sha256) of the files under path, each hashed by the task that reads it; empty files aren't listed.

    Files of up to whole_bytes are read whole, as any store that Spark can open gives them; larger ones chunk by chunk.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = [F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes")]
    small = files.where(F.col("length") <= whole_bytes).select(*named, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select("path", "length")
    return small.unionByName(archives.hashes(large).join(large, "path").select(*named, "sha256"))


def stamp() -> str:
    """Now in UTC, for manifests and file names, never for data columns."""
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


def config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def snapshot(cfg: dict, name: str) -> dict:
    """The named snapshot; a KeyError lists those there are."""
    known = cfg.get("snapshots") or {}
    if name not in known:
        raise KeyError(f"unknown snapshot {name!r}; there are {', '.join(sorted(known)) or 'none'}")
    return known[name]


def token(variable: str, path: str, placeholder: str = "PASTE") -> str:
    """An access token from the environment, or else from a file that isn't a placeholder."""
    if found := os.environ.get(variable, "").strip():
        return found
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            found = f.read().strip()
        if found and not found.startswith(placeholder):
            return found
    raise RuntimeError(f"set {variable} or put a token into {path}")


class _Report(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class ReportReader(DataSourceReader):
    """One task for each report; a report that fails `tries` times has no rows."""

    def __init__(self, options: dict) -> None:
        self.o = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Report(x.strip()) for x in self.o["reports"].split(",") if x.strip()]

    def read(self, part: _Report) -> Iterator[tuple]:
        query = {k: self.o[k] for k in ("start", "end", "polygon", "limit") if k in self.o}
        if "box" in self.o:
            box = tuple(map(float, self.o["box"].split(",")))
            query["polygon"] = json.dumps({"type": "Polygon", "coordinates": [[list(p) for p in closed_ring(box)]]})
        url = f"{self.o['url'].rstrip('/')}/{part.name}?{urllib.parse.urlencode(query)}"
        head = {"User-Agent": AGENT} | ({"Authorization": f"Bearer {self.o['token']}"} if "token" in self.o else {})
        entries: list = []
        for k in range(int(self.o.get("tries", 3))):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=float(self.o.get("timeout", 180))) as r:
                    entries = json.load(r)
                break
            except (OSError, ValueError):
                time.sleep(float(self.o.get("wait", 2)) * (k + 1 < int(self.o.get("tries", 3))))
        for e in entries[: int(self.o["limit"])] if "limit" in self.o else entries:
            yield part.name, e.get("lat"), e.get("lon"), json.dumps(e)


class ReportSource(DataSource):
    """spark.read.format("vessel_reports"): detections, presence and gap events of an HTTP report API as rows.

    Options: url, reports (comma-separated), start, end, polygon (GeoJSON) or box (west,south,east,north), limit, token, tries, wait, timeout.
    """

    @classmethod
    def name(cls) -> str:
        return "vessel_reports"

    def schema(self) -> str:
        return "report string, lat double, lon double, entry string"

    def reader(self, schema) -> ReportReader:
        return ReportReader(self.options)


class _Span(InputPartition):
    def __init__(self, begin: int, end: int) -> None:
        self.begin, self.end = begin, end


class MessageReader(DataSourceStreamReader):
    """Offsets are message numbers of the feed; a batch is dealt to tasks in spans of `span` messages.

    A feed that can't be reached has nothing new until the next trigger, so the stream goes on by itself
    when it is back. A span that a task can't fetch fails the batch, which is then run again from its offsets.
    """

    def __init__(self, options: dict) -> None:
        self.o = dict(options)
        self.known = self.missed = 0

    def _get(self, path: str) -> object:
        request = urllib.request.Request(f"{self.o['url'].rstrip('/')}/{path}", headers={"User-Agent": AGENT})
        with urllib.request.urlopen(request, timeout=float(self.o.get("timeout", 30))) as r:
            return json.load(r)

    def initialOffset(self) -> dict:
        return {"at": int(self.o.get("from", 0))}

    def latestOffset(self) -> dict:
        try:
            self.known = max(self.known, int(self._get("latest")))
            self.missed = 0
        except (OSError, ValueError, TypeError) as e:
            self.missed += 1
            logging.getLogger(__name__).warning("the feed didn't answer, %d times in a row: %s", self.missed, e)
        return {"at": max(self.known, self.initialOffset()["at"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        step = int(self.o.get("span", 10_000))
        return [_Span(a, min(a + step, end["at"])) for a in range(start["at"], end["at"], step)]

    def read(self, part: _Span) -> Iterator[tuple]:
        tries = int(self.o.get("tries", 3))
        for k in range(tries):
            try:
                found = self._get(f"messages?from={part.begin}&to={part.end}")
                break
            except (OSError, ValueError):
                if k + 1 == tries:
                    raise
                time.sleep(float(self.o.get("wait", 5)))
        for n, message in enumerate(found):
            yield part.begin + n, json.dumps(message)

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["at"])


class MessageSource(DataSource):
    """spark.readStream.format("vessel_messages"): a numbered feed of JSON messages.

    Options: url (which serves latest and messages?from=&to=), from, span, tries, wait, timeout.
    """

    @classmethod
    def name(cls) -> str:
        return "vessel_messages"

    def schema(self) -> str:
        return "number long, value string"

    def streamReader(self, schema) -> MessageReader:
        return MessageReader(self.options)

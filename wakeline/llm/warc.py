"""WARC archives whose records are compressed one by one with a Zstandard dictionary.

The dictionary is built from a bounded sample of the records and stands in a leading skippable frame
of each archive, so an archive can be read on its own.
"""

from __future__ import annotations

import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, fresh_path, map_batches

#: Payloads shorter than this are stored each for itself.
REVISIT_BYTES = 1000
#: The dictionary is trained on at most so many records, of each the first so many bytes.
SAMPLE_RECORDS, SAMPLE_BYTES = 1000, 16384
DICTIONARY_BYTES = 65536
#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 32 << 20
_MAGIC = 0x184D2A5D
_NAME = "urn:page:"


def record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP headers only, its payload is the response's."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_NAME}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record's fields; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda s: int(s) if (s := s.strip("<>").removeprefix(_NAME)) else None
    if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (n, digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": page(fields["WARC-Record-ID"]), "url": urllib.parse.unquote(fields["WARC-Target-URI"]), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload}


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; samples too few to train on serve as a raw one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def frames(data: bytes) -> Iterator[tuple[int, int]]:
    """Where each frame of an archive begins and ends, by its block headers."""
    at = 0
    while at < len(data):
        begin = at
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        else:
            part = data[at : at + 18]
            at += zstandard.frame_header_size(part)
            while True:
                block = int.from_bytes(data[at : at + 3], "little")
                at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
                if block & 1:
                    break
            at += 4 * zstandard.get_frame_parameters(part).has_checksum
        yield begin, at


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive, by the dictionary in its leading frame."""
    reader = None
    for a, b in frames(data):
        if reader is None:
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[a + 8 : b])) if b > a + 8 else zstandard.ZstdDecompressor()
        else:
            yield reader.decompress(data[a:b])


def _write(folder: str, dictionary: bytes, level: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        out, name, size, n = None, "", 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    # each attempt writes files of its own; only those in the returned rows are ever read
                    name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{top}/{name}")
                    out.write(struct.pack("<II", _MAGIC, len(dictionary)) + dictionary)
                    size = 8 + len(dictionary)
                raw = packer.compress(record(r["page_id"], r["url"], r["html"], r["digest"], r["refers_to"], r["revisit"]))
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    out.close()
                    yield row()
                    out = None
        if out is not None:
            out.close()
            yield row()

    return run


def write_warc(pages: DataFrame, folder: str, level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives under folder; returns (archive, records, bytes).

    Of rows with equal payloads of at least REVISIT_BYTES, the one with the largest page_id is the
    response and the others revisit it; repeated rows with that page_id are all responses. A null html
    is an empty payload. A null page_id is never the largest unless all are null, which makes all of
    them responses. Other columns are ignored. No rows give no archives.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long = F.octet_length("html") >= REVISIT_BYTES
    same = cut(rows.where(long).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL").select(F.col("digest").alias("of"), "last"), "payloads")
    # short payloads match nothing; a key of their own deals equal ones, such as all that are empty, to many tasks
    own = F.when(long, F.col("digest")).otherwise(F.concat(F.lit("short-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("key", own).join(same, F.col("key") == F.col("of"), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("last")) & F.col("last").isNotNull(), F.lit(False))
    ready = joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))
    # a hash picks some four times the sample, so that tasks don't each send a whole one to the driver
    mixed, share = F.xxhash64("digest", "page_id"), min(1.0, 4 * SAMPLE_RECORDS / max(1, pages.count()))
    few = rows.where(F.pmod(mixed, F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = few.select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html"), "digest").orderBy(mixed, "page_id").limit(SAMPLE_RECORDS).collect()
    dictionary = train([record(r["page_id"], r["url"], r["html"], r["digest"], None, False)[:SAMPLE_BYTES] for r in sample])
    return cut(map_batches(ready, _write(folder, dictionary, level, archive_bytes), "archive string, records long, bytes long"), "archives")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)))
        for b in batches:
            for name in b.column("archive").to_pylist():
                with store.open_input_stream(f"{top}/{name}") as f:
                    data = f.read()
                held, size = [], 0
                for raw in read_archive(data):
                    held.append(parse(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_warc(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the archives that write_warc returned: header fields, and the payload of responses."""
    n = max(1, archives.count())
    return map_batches(archives.select("archive").repartition(n), _read(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
same AS (SELECT html, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY 1)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN same ON p.n >= 1000 AND p.html = same.html
"""

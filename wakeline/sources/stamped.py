"""A streaming sink of Parquet files with UTC names, in two phases: each row is there once, whatever breaks.

Tasks write files under hidden names. A batch is committed by one small file that lists them with the names they are to get, and by
renaming them. A batch that is run again after that finds the list, finishes the renaming and drops its own files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from wakeline.sources.archives import located


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class StampedWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.prefix = options["path"], options.get("prefix", "part")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """A task's rows as one hidden file, none if there are no rows."""
        store, at = located(self.path)
        name, writer, rows = f".{uuid.uuid4().hex}.parquet", None, 0
        try:
            for b in batches:
                if b.num_rows:
                    if writer is None:
                        store.create_dir(at, recursive=True)
                        writer = pq.ParquetWriter(f"{at}/{name}", b.schema, compression="zstd", filesystem=store)
                    writer.write_batch(b)
                    rows += b.num_rows
        finally:
            if writer is not None:
                writer.close()
        return _Written(name if rows else "", rows)

    def _list(self, batch: int) -> str:
        return f"{located(self.path)[1]}/_batches/{batch:012d}.json"

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        store, at = located(self.path)
        own = [m for m in messages if m is not None and m.name]
        if store.get_file_info(self._list(batchId)).type == fs.FileType.NotFound:
            stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
            names = {m.name: f"{self.prefix}-{stamp}-{batchId:06d}-{k:05d}.parquet" for k, m in enumerate(own)}
            store.create_dir(f"{at}/_batches", recursive=True)
            with store.open_output_stream(f"{self._list(batchId)}.part") as f:
                f.write(json.dumps({"names": names, "rows": sum(m.rows for m in own)}).encode())
            # from here on the batch is committed
            store.move(f"{self._list(batchId)}.part", self._list(batchId))
        else:
            with store.open_input_stream(self._list(batchId)) as f:
                names = json.loads(f.read())["names"]
        for hidden, name in names.items():
            if store.get_file_info(f"{at}/{hidden}").type == fs.FileType.File:
                store.move(f"{at}/{hidden}", f"{at}/{name}")
        self._drop([m.name for m in own if m.name not in names])

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        self._drop([m.name for m in messages if m is not None and m.name])

    def _drop(self, names: list[str]) -> None:
        store, at = located(self.path)
        for name in names:
            if store.get_file_info(f"{at}/{name}").type == fs.FileType.File:
                store.delete_file(f"{at}/{name}")


class StampedSink(DataSource):
    """writeStream.format("vessel_stamped"): options path (a folder that all executors share) and prefix.

    Files are named prefix-UTC-batch-task.parquet; a batch without rows has no file. Hidden files of a driver that died before it
    committed stay, and no reader of the folder sees them.
    """

    @classmethod
    def name(cls) -> str:
        return "vessel_stamped"

    def streamWriter(self, schema, overwrite: bool) -> StampedWriter:
        return StampedWriter(self.options)

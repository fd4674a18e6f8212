"""A live WebSocket feed as a streaming source, with what arrives kept in a spool until it is read.

A feed can't be asked for old messages, so one thread beside the query's planner holds the connection and writes messages into
numbered files of a shared folder. Offsets are numbers of files: tasks read files, a batch that fails is read again
from them, and a query that starts anew goes on where its checkpoint says.
"""

from __future__ import annotations

import base64
import hashlib
import json
import logging
import os
import socket
import ssl
import struct
import threading
import time
import urllib.parse
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from wakeline.sources.archives import located

# fixed value: the protocol's own
_MAGIC = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
_TEXT, _BINARY, _CLOSE, _PING, _PONG = 1, 2, 8, 9, 10
#: Bytes of a message that is taken at most; a longer one ends the connection.
LONGEST = 16 << 20


class Connection:
    """A client's side of one WebSocket connection: messages as text, pings answered."""

    def __init__(self, url: str, timeout: float = 30.0) -> None:
        at = urllib.parse.urlsplit(url)
        secure = at.scheme == "wss"
        self.sock = socket.create_connection((at.hostname, at.port or (443 if secure else 80)), timeout)
        if secure:
            self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=at.hostname)
        self.file = self.sock.makefile("rb")
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        head = [f"GET {path} HTTP/1.1", f"Host: {at.netloc}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key}", "Sec-WebSocket-Version: 13"]
        self.sock.sendall(("\r\n".join(head) + "\r\n\r\n").encode())
        status = self.file.readline()
        fields = {}
        while (line := self.file.readline().strip()) != b"":
            name, _, value = line.decode("latin-1").partition(":")
            fields[name.strip().lower()] = value.strip()
        if b" 101 " not in status or fields.get("sec-websocket-accept") != accepted(key):
            raise ConnectionError(f"no WebSocket: {status!r}")

    def send(self, raw: bytes, kind: int = _TEXT) -> None:
        mask = os.urandom(4)
        size = bytes([0x80 | len(raw)]) if len(raw) < 126 else b"\xfe" + struct.pack(">H", len(raw)) if len(raw) < 1 << 16 else b"\xff" + struct.pack(">Q", len(raw))
        self.sock.sendall(bytes([0x80 | kind]) + size + mask + bytes(b ^ mask[k % 4] for k, b in enumerate(raw)))

    def _exactly(self, n: int) -> bytes:
        raw = self.file.read(n)
        if len(raw) < n:
            raise ConnectionError("the feed broke off")
        return raw

    def messages(self) -> Iterator[str]:
        """Whole messages until the server closes; a break is a ConnectionError."""
        held: list[bytes] = []
        while True:
            first, second = self._exactly(2)
            size = second & 127
            if size > 125:
                (size,) = struct.unpack(">H", self._exactly(2)) if size == 126 else struct.unpack(">Q", self._exactly(8))
            if size + sum(map(len, held)) > LONGEST:
                raise ConnectionError("a message is too long")
            mask = self._exactly(4) if second & 128 else None
            raw = self._exactly(size)
            if mask:
                raw = bytes(b ^ mask[k % 4] for k, b in enumerate(raw))
            kind = first & 15
            if kind == _CLOSE:
                return
            if kind == _PING:
                self.send(raw, _PONG)
            elif kind in (0, _TEXT, _BINARY):
                held.append(raw)
                if first & 128:
                    yield b"".join(held).decode("utf-8", "replace")
                    held = []

    def close(self) -> None:
        self.file.close()
        self.sock.close()


def accepted(key: str) -> str:
    """What a server answers to a client's key."""
    return base64.b64encode(hashlib.sha1((key + _MAGIC).encode()).digest()).decode()


class Spool:
    """Numbered files of JSON lines, each written as a whole under another name first."""

    def __init__(self, path: str) -> None:
        self.path = path

    def count(self) -> int:
        """The number of the next file."""
        store, at = located(self.path)
        store.create_dir(at, recursive=True)
        names = [x.base_name for x in store.get_file_info(fs.FileSelector(at))]
        return max((int(n[:-5]) + 1 for n in names if n.endswith(".json")), default=0)

    def put(self, number: int, rows: list[tuple[float, str]]) -> None:
        store, at = located(self.path)
        with store.open_output_stream(f"{at}/.{number:012d}") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        store.move(f"{at}/.{number:012d}", f"{at}/{number:012d}.json")

    def rows(self, number: int) -> Iterator[tuple[int, float, str]]:
        store, at = located(self.path)
        with store.open_input_stream(f"{at}/{number:012d}.json") as f:
            for k, line in enumerate(f.read().decode().splitlines()):
                seen, value = json.loads(line)
                yield k, seen, value

    def drop(self, below: int) -> None:
        store, at = located(self.path)
        for x in store.get_file_info(fs.FileSelector(at)):
            if x.base_name.endswith(".json") and int(x.base_name[:-5]) < below:
                store.delete_file(x.path)


class _File(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class SocketReader(DataSourceStreamReader):
    """Connects at the first trigger, subscribes, and again after each break, `wait` seconds later.

    A trigger closes the file that is being filled, so every message is in one batch. Files are deleted once the batch
    with them is committed. A file is also closed when it has `rows` messages.
    """

    def __init__(self, options: dict) -> None:
        self.o = dict(options)
        self.spool = Spool(self.o["spool"])
        self._begin()

    def _begin(self) -> None:
        self.thread: threading.Thread | None = None
        self.lock, self.ended = None, False
        self.held: list[tuple[float, str]] = []
        self.next = 0

    def __getstate__(self) -> dict:
        return {"o": self.o, "spool": self.spool}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._begin()

    def _flush(self) -> None:
        if self.held:
            self.spool.put(self.next, self.held)
            self.held, self.next = [], self.next + 1

    def _listen(self) -> None:
        while not self.ended:
            connection = None
            try:
                connection = Connection(self.o["url"], float(self.o.get("timeout", 30)))
                if "subscribe" in self.o:
                    connection.send(self.o["subscribe"].encode())
                for message in connection.messages():
                    with self.lock:
                        if self.ended:
                            break
                        self.held.append((time.time(), message))
                        if len(self.held) >= int(self.o.get("rows", 10_000)):
                            self._flush()
            except OSError as e:
                logging.getLogger(__name__).warning("the feed broke off: %s", e)
            finally:
                if connection is not None:
                    connection.close()
            if not self.ended:
                time.sleep(float(self.o.get("wait", 5)))

    def initialOffset(self) -> dict:
        return {"file": self.spool.count() if self.o.get("begin") == "now" else 0}

    def latestOffset(self) -> dict:
        if self.thread is None:
            self.lock, self.next = threading.Lock(), self.spool.count()
            self.thread = threading.Thread(target=self._listen, daemon=True)
            self.thread.start()
        with self.lock:
            self._flush()
            return {"file": self.next}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(n) for n in range(start["file"], end["file"])]

    def read(self, part: _File) -> Iterator[tuple]:
        for k, seen, value in self.spool.rows(part.number):
            yield part.number, k, seen, value

    def commit(self, end: dict) -> None:
        # the last file stays, so that a new start knows how far numbers went
        self.spool.drop(end["file"] - 1)

    def stop(self) -> None:
        self.ended = True
        if self.lock is not None:
            with self.lock:
                self._flush()


class SocketSource(DataSource):
    """spark.readStream.format("vessel_socket"): (file, n, seen, value) of the messages of a WebSocket feed.

    Options: url (ws or wss), spool (a shared folder of this query alone), subscribe (a message sent after connecting), rows, wait, timeout,
    begin (now: files that an earlier query left aren't read).
    """

    @classmethod
    def name(cls) -> str:
        return "vessel_socket"

    def schema(self) -> str:
        return "file long, n int, seen double, value string"

    def streamReader(self, schema) -> SocketReader:
        return SocketReader(self.options)

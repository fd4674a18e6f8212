"""A WebSocket feed from a local server that breaks off, through restarts of the query."""

import json
import socket
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from wakeline.sources import websocket


class Feed:
    """Sends numbered messages to one client at a time, some in fragments, with pings between; drops the connection now and then."""

    def __init__(self, total, drop_every):
        self.total, self.drop_every, self.sent, self.subscribed, self.pongs = total, drop_every, 0, [], 0
        self.server = socket.create_server(("127.0.0.1", 0))
        self.port = self.server.getsockname()[1]
        threading.Thread(target=self.serve, daemon=True).start()

    @staticmethod
    def frame(raw, kind=1, fin=True):
        size = bytes([len(raw)]) if len(raw) < 126 else b"\x7e" + struct.pack(">H", len(raw)) if len(raw) < 1 << 16 else b"\x7f" + struct.pack(">Q", len(raw))
        return bytes([(0x80 if fin else 0) | kind]) + size + raw

    def receive(self, f):
        first, second = f.read(2)
        size = second & 127
        size = size if size < 126 else struct.unpack(">H", f.read(2))[0] if size == 126 else struct.unpack(">Q", f.read(8))[0]
        mask = f.read(4)
        return first & 15, bytes(b ^ mask[k % 4] for k, b in enumerate(f.read(size)))

    def serve(self):
        while True:
            client, _ = self.server.accept()
            try:
                self.talk(client)
            except (OSError, ValueError):
                pass  # the client went
            client.close()

    def talk(self, client):
        f = client.makefile("rb")
        key = ""
        while (line := f.readline().strip()) != b"":
            if line.lower().startswith(b"sec-websocket-key"):
                key = line.split(b":", 1)[1].strip().decode()
        client.sendall(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nSec-WebSocket-Accept: {websocket.accepted(key)}\r\n\r\n".encode())
        kind, raw = self.receive(f)
        self.subscribed.append(json.loads(raw))
        client.sendall(self.frame(b"hello", 9))
        self.pongs += self.receive(f) == (10, b"hello")
        while self.sent < self.total:
            raw = json.dumps({"id": self.sent, "pad": "é" * (70_000 if self.sent == 7 else 80 if self.sent % 3 else 1)}).encode()
            client.sendall(self.frame(raw[:5], 1, False) + self.frame(raw[5:], 0) if self.sent % 4 == 0 else self.frame(raw))
            self.sent += 1
            if self.sent % self.drop_every == 0:
                break
            time.sleep(0.002)
        if self.sent >= self.total:
            client.sendall(self.frame(b"", 8))


def test_stream_through_breaks_and_restarts(spark, tmp_path):
    feed = Feed(600, 90)
    spark.dataSource.register(websocket.SocketSource)
    out, spool, seen = f"file://{tmp_path}/out", f"file://{tmp_path}/spool", 0

    def begin():
        options = {"url": f"ws://127.0.0.1:{feed.port}/v0?x=1", "subscribe": '{"Box": [1, 2]}', "spool": spool, "rows": "50", "wait": "0.05"}
        stream = spark.readStream.format("vessel_socket").options(**options).load()
        return stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="300 milliseconds").start(out)

    for goal in (200, 600):
        q = begin()
        until = time.time() + 60
        quiet = 0
        while seen < goal and time.time() < until and q.isActive and quiet < 12:
            time.sleep(0.3)
            quiet = quiet + 1 if feed.sent >= feed.total else 0
            try:
                seen = spark.read.schema("file long, n int, seen double, value string").parquet(out).count()
            except Exception:
                seen = 0
        q.stop()
        assert q.exception() is None
        # what arrived while the query was stopping is in the spool for the next one
        time.sleep(0.5)
    rows = spark.read.parquet(out).select(F.get_json_object("value", "$.id").cast("int").alias("id"), "file", "n").collect()
    ids = sorted(r["id"] for r in rows)
    assert len(ids) == len(set(ids)), "a message twice"
    # a live feed goes on without us: only what it sent while no query ran may be missing
    assert set(range(200)) <= set(ids) and len(ids) >= 400
    assert len({(r["file"], r["n"]) for r in rows}) == len(rows)
    assert feed.subscribed and all(s == {"Box": [1, 2]} for s in feed.subscribed) and feed.pongs == len(feed.subscribed) >= 6


def test_no_websocket_there():
    server = socket.create_server(("127.0.0.1", 0))
    threading.Thread(target=lambda: server.accept()[0].sendall(b"HTTP/1.1 404 Not Found\r\n\r\n"), daemon=True).start()
    with pytest.raises(ConnectionError, match="404"):
        websocket.Connection(f"ws://127.0.0.1:{server.getsockname()[1]}", 5)

"""A live stream of captured packets over a socket: streaming source ``pcap_socket`` (options host, port, segments, resume).

A capture tool sends a classic pcap stream. Whole records are written to a segment, a capture file in the folder ``segments`` that all executors share,
before their offset is given to Spark, so a batch that is tried again, or a query that starts again from its checkpoint, reads the same packets. Segments go once
their batch is committed; only the driver's reader touches the socket, tasks read segments.

With ``resume`` ("true") the source opens each connection by sending 8 bytes, big-endian: how much of the stream, header included, is
in segments. The sender goes on from there, so nothing is lost or doubled when the connection or the driver is. Without it every connection starts with a file header
and what was under way when one broke is lost.
"""

from __future__ import annotations

import json
import os
import socket
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.types import StructType

from packetlens.plans.session import ship
from packetlens.schema import PACKET_SCHEMA
from packetlens.sources.capture import CLASSIC, CaptureError, read_packets
from packetlens.sources.pcap import FilePartition, to_arrow
from packetlens.sources.ranges import local_path, read_range

STATE = "state.json"
#: Bytes of a segment at most, bytes of one receive, seconds to wait for more.
SEGMENT_BYTES, RECEIVE, WAIT = 64 << 20, 1 << 20, 0.2


class Segments:
    """The write-ahead folder: numbered captures, and a small file with the next number, the stream bytes that are in segments, and the file header."""

    def __init__(self, folder: str):
        self.folder = local_path(folder)
        os.makedirs(self.folder, exist_ok=True)
        self.next, self.bytes, self.header = 0, 0, b""
        if os.path.exists(self._at(STATE)):
            with open(self._at(STATE)) as f:
                state = json.load(f)
            self.next, self.bytes, self.header = state["next"], state["bytes"], bytes.fromhex(state["header"])
        # a segment that was written just before the reader died
        while os.path.exists(self.path(self.next)):
            data = read_range(self.path(self.next), 0)
            self.bytes += len(data) - (24 if self.header == data[:24] else 0)
            self.header, self.next = data[:24], self.next + 1

    def _at(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def path(self, number: int) -> str:
        return self._at(f"{number:012d}.pcap")

    def _write(self, name: str, data: bytes) -> None:
        with open(self._at(name + ".part"), "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self._at(name + ".part"), self._at(name))

    def add(self, header: bytes, records: bytes) -> None:
        self._write(os.path.basename(self.path(self.next)), header + records)
        self.bytes += len(records) + (0 if self.header == header else len(header))
        self.next, self.header = self.next + 1, header
        self._write(STATE, json.dumps({"next": self.next, "bytes": self.bytes, "header": header.hex()}).encode())

    def forget(self, before: int) -> None:
        for name in os.listdir(self.folder):
            if name.endswith(".pcap") and int(name[:-5]) < before:
                os.remove(self._at(name))


def whole_records(header: bytes, data: bytes | bytearray) -> int:
    """How many bytes of ``data`` are whole records."""
    size = struct.Struct(CLASSIC[header[:4]][0] + "I").unpack_from
    at = 0
    while at + 16 <= len(data) and at + 16 + size(data, at + 8)[0] <= len(data):
        at += 16 + size(data, at + 8)[0]
    return at


class PcapSocketReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port = options["host"], int(options["port"])
        self.folder, self.resume = options["segments"], options.get("resume", "false").lower() == "true"
        self.connection: socket.socket | None = None
        self.segments: Segments | None = None

    def initialOffset(self):
        return {"segment": 0}

    def latestOffset(self):
        self.segments = self.segments or Segments(self.folder)
        try:
            self._receive()
        except OSError:  # refused or broken: the next call connects again
            self._close()
        return {"segment": self.segments.next}

    def _connect(self) -> None:
        if self.connection is None:
            self.connection = socket.create_connection((self.host, self.port), timeout=WAIT)
            self.held, self.header = bytearray(), self.segments.header if self.resume else b""
            if self.resume:
                self.connection.sendall(self.segments.bytes.to_bytes(8, "big"))

    def _receive(self) -> None:
        """What the socket has, up to a segment's size; its whole records become a segment."""
        self._connect()
        closed = False
        try:
            while len(self.held) < SEGMENT_BYTES:
                data = self.connection.recv(RECEIVE)
                if not data:
                    closed = True
                    break
                self.held += data
        except TimeoutError:
            pass
        if not self.header and len(self.held) >= 24:
            self.header, self.held = bytes(self.held[:24]), self.held[24:]
            if self.header[:4] not in CLASSIC:
                raise CaptureError("not a pcap stream")
        if self.header and (n := whole_records(self.header, self.held)):
            self.segments.add(self.header, bytes(self.held[:n]))
            self.held = self.held[n:]
        if closed:
            self._close()

    def _close(self) -> None:
        if self.connection is not None:
            self.connection.close()
        self.connection = None

    def partitions(self, start, end):
        path = Segments(self.folder).path
        return [FilePartition(path(n)) for n in range(start["segment"], end["segment"])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield from to_arrow(read_packets(read_range(partition.path, 0)))

    def commit(self, end):
        # the newest batch stays: a query that starts again may ask for it once more
        if self.segments is not None:
            self.segments.forget(self.committed)
        self.committed = end["segment"]

    committed = 0

    def stop(self):
        self._close()


class PcapSocketSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap_socket"

    def schema(self):
        return PACKET_SCHEMA

    def streamReader(self, schema: StructType):
        return PcapSocketReader(self.options)


def stream_socket(spark: SparkSession, host: str, port: int, segments: str, resume: bool = False) -> DataFrame:
    """Packets of a live pcap stream; ``segments`` is a folder that the driver and all executors share, one for each query."""
    ship(spark)
    spark.dataSource.register(PcapSocketSource)
    return spark.readStream.format("pcap_socket").options(host=host, port=port, segments=segments, resume=str(resume).lower()).load()

"""The live source: a local sender that breaks off, queries that die and start again; no packet lost or doubled."""

import os
import random
import socket
import threading
import time

from conftest import rows
from py4j.protocol import Py4JJavaError
from test_capture import many_packets, pcap

from packetlens.plans.store import read_store
from packetlens.sources import socket as live
from packetlens.sources.capture import read_packets
from packetlens.sources.pcap import read_pcap
from packetlens.streaming.live import stream_ingest


class Sender:
    """Sends ``data`` from where the receiver asks, in pieces of any size, and breaks off now and then."""

    def __init__(self, data, breaks, seed=1):
        self.data, self.breaks, self.rng = data, breaks, random.Random(seed)
        self.server = socket.create_server(("127.0.0.1", 0))
        self.port, self.asked, self.open = self.server.getsockname()[1], [], True
        threading.Thread(target=self.run, daemon=True).start()

    def run(self):
        while self.open:
            try:
                connection, _ = self.server.accept()
            except OSError:
                return
            with connection:
                try:
                    at = int.from_bytes(connection.recv(8), "big")
                    self.asked.append(at)
                    stop = len(self.data) if len(self.asked) > self.breaks else min(len(self.data), at + self.rng.randrange(10_000, 60_000))
                    while at < stop:
                        n = min(stop - at, self.rng.randrange(1, 9000))
                        connection.sendall(self.data[at : at + n])
                        at += n
                    if stop == len(self.data):
                        while self.open:
                            time.sleep(0.1)
                except OSError:
                    pass

    def close(self):
        self.open = False
        self.server.close()


def reader(sender, folder):
    return live.PcapSocketReader({"host": "127.0.0.1", "port": str(sender.port), "segments": str(folder), "resume": "true"})


def packets_of(reader, start, end):
    return [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]


def test_segments_hold_the_stream_whatever_breaks(tmp_path):
    data = pcap(many_packets(900))
    want = [r for b in live.to_arrow(read_packets(data)) for r in b.to_pylist()]
    sender, folder, seen, rng = Sender(data, breaks=6), tmp_path / "segments", [], random.Random(3)
    now, at, until = reader(sender, folder), {"segment": 0}, time.time() + 60
    while len(seen) < len(want) and time.time() < until:
        end = now.latestOffset()
        if rng.random() < 0.2:  # the reader dies after the segment was written; its successor goes on
            now.stop()
            now = reader(sender, folder)
            if rng.random() < 0.5 and (folder / live.STATE).exists():
                os.remove(folder / live.STATE)
                now.segments = None
        if end != at:
            got = packets_of(now, at, end)
            assert got == packets_of(now, at, end)  # an offset can be read again
            seen += got
            at = end
    now.stop()
    sender.close()
    assert seen == want and len(sender.asked) > 6


def test_committed_segments_go(tmp_path):
    s = live.Segments(str(tmp_path / "s"))
    header, body = pcap([])[:24], pcap(many_packets(3))[24:]
    for _ in range(3):
        s.add(header, body)
    again = live.Segments(str(tmp_path / "s"))
    assert (again.next, again.bytes, again.header) == (3, 24 + 3 * len(body), header)
    s.forget(2)
    assert sorted(os.listdir(tmp_path / "s")) == ["000000000002.pcap", live.STATE] and live.Segments(str(tmp_path / "s")).next == 3
    assert live.whole_records(header, body[:-1]) < len(body) and live.whole_records(header, body) == len(body) and live.whole_records(header, b"") == 0


def test_a_query_killed_and_started_again_loses_and_doubles_nothing(spark, tmp_path):
    data = pcap(many_packets(2000))
    (tmp_path / "all.pcap").write_bytes(data)
    want = rows(read_pcap(spark, str(tmp_path / "all.pcap")))
    sender, store = Sender(data, breaks=4), str(tmp_path / "store")

    def count():
        try:
            return read_store(spark, store).df.count() if os.path.exists(store) else 0
        except Py4JJavaError:  # a batch that is tried again is written anew while it is read
            return 0

    def start():
        return stream_ingest(live.stream_socket(spark, "127.0.0.1", sender.port, str(tmp_path / "segments"), resume=True), store, str(tmp_path / "progress"), {"processingTime": "0 seconds"}, partitions=1)

    query, until, least = start(), time.time() + 150, 1
    while count() < len(want) and time.time() < until:
        if count() >= least:  # stopped in the middle of whatever it does
            query.stop()
            query, least = start(), count() + 700
        time.sleep(0.3)
    query.stop()
    sender.close()
    assert rows(read_store(spark, store).df.select("src_ip", "dst_ip", "src_port", "dst_port", "proto", "length", "ts")) == want

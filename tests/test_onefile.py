"""The single capture file: byte for byte what one sorted list of packets gives."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.schema import PACKET_COLUMNS
from packetlens.sinks import onefile
from packetlens.sinks.onefile import parts_of, time_slots, write_one_file
from packetlens.sources.capture import FILE_HEADER, packet_records
from packetlens.testdata import packets

SCHEMA = "src_ip long, dst_ip long, src_port int, dst_port int, proto short, length int, us long"


def expected(rows) -> bytes:
    # ties by addresses, then ports and length, as unsigned numbers
    code = {1: 0, 6: 1, 17: 2}
    rows = sorted(rows, key=lambda r: (r[6] * 4 + code[r[4]], np.int64(np.uint64(r[0] << 32 | r[1])), np.int64(np.uint64(r[2] << 48 | r[3] << 32 | r[5]))))
    return FILE_HEADER + packet_records(*np.array(rows, np.int64).reshape(-1, 7).T)


def random_rows(rng, n, times):
    out = []
    for t in rng.choice(times, n):
        proto = int(rng.choice([1, 6, 17]))
        ports = (0, 0) if proto == 1 else (int(rng.integers(0, 65536)), int(rng.integers(0, 65536)))
        out.append((int(rng.integers(0, 2**32)), int(rng.integers(0, 3)), *ports, proto, int(rng.choice([40, 60, 70_000])), int(t)))
    return out


@pytest.mark.parametrize(
    ("times", "rows", "slots"),
    [
        (np.arange(1_700_000_000_000_000, 1_700_000_000_004_000), 50, 7),  # even
        (np.array([1_700_000_000_000_000] * 9 + [1_900_000_000_000_000]), 20, 4),  # one crowded microsecond
        (np.concatenate([1_700_000_000_000_000 + np.arange(30), [1, 2_000_000_000_000_000]]), 13, 3),  # a burst in a long time
        (np.array([5]), 1000, 10),
    ],
)
def test_bytes_equal_a_sorted_list(spark, tmp_path, times, rows, slots):
    data = random_rows(np.random.default_rng(len(times)), 400, times)
    df = spark.createDataFrame(data, SCHEMA).withColumn("ts", F.timestamp_micros("us")).repartition(3)
    path = str(tmp_path / "a.pcap")
    assert write_one_file(df, path, rows=rows, slots=slots) == 400
    got = open(path, "rb").read()
    parts = parts_of(time_slots(df, rows, slots), rows)
    assert sum(p.packets for p in parts) == 400 and all(b.at == a.at + a.bytes for a, b in zip(parts, parts[1:], strict=False))
    assert len(parts) > 2 or len(times) == 1
    if all(p.share < 0 for p in parts):
        assert got == expected(data)
    else:  # within a crowded microsecond the order goes by hash first
        cut = lambda data: sorted(_records(data))
        assert cut(got) == cut(expected(data)) and [r[:8] for r in _records(got)] == [r[:8] for r in _records(expected(data))]
    assert os.listdir(tmp_path) == ["a.pcap"]


def _records(data: bytes) -> list[bytes]:
    out, at = [], len(FILE_HEADER)
    while at < len(data):
        n = 16 + int.from_bytes(data[at + 8 : at + 12], "little")
        out.append(data[at : at + n])
        at += n
    return out


def test_partitions_are_bounded_and_written_side_by_side(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(onefile, "ROWS", 100)
    df = packets(spark, sf)
    slots = time_slots(df.withColumn("us", F.unix_micros("ts")), 100, 64)
    parts = parts_of(slots, 100)
    assert len(parts) >= 10 and max(p.packets for p in parts) <= 100
    assert write_one_file(df.select(*PACKET_COLUMNS), str(tmp_path / "b.pcap"), rows=100, slots=64) == 1000
    times = [r[:8] for r in _records((tmp_path / "b.pcap").read_bytes())]
    assert len(times) == 1000
    seconds = [(int.from_bytes(t[:4], "little"), int.from_bytes(t[4:], "little")) for t in times]
    assert seconds == sorted(seconds)


def test_no_packets_and_other_protocols(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    assert write_one_file(empty, str(tmp_path / "e.pcap")) == 0 and (tmp_path / "e.pcap").read_bytes() == FILE_HEADER
    other = spark.createDataFrame([(1, 2, 3, 4, 47, 60, 5)], SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    with pytest.raises(Exception, match="only TCP, UDP and ICMP"):
        write_one_file(other, str(tmp_path / "o.pcap"))
    assert not (tmp_path / "o.pcap").exists() and os.listdir(tmp_path) == ["e.pcap"]

import random
import struct

import pytest
from conftest import rows

from packetlens.sources import capture
from packetlens.sources import pcap as pcap_source
from packetlens.sources.pcap import capture_statistics, read_pcap, register
from packetlens.streaming.live import stream_ingest, stream_packets


def ipv4(proto, src="10.0.0.1", dst="10.0.0.2", body=b"", fragment=0):
    octets = lambda a: bytes(map(int, a.split(".")))
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, fragment, 64, proto, 0, octets(src), octets(dst)) + body


def ports(a, b, rest=b"\0" * 16):
    return struct.pack("!HH", a, b) + rest


def ether(payload, kind=0x0800, tags=b""):
    return b"\xaa" * 12 + tags + struct.pack("!H", kind) + payload


def pcap(packets, link=1, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, (data, *more) in enumerate(packets):
        original, sec, sub = (more + [len(data), 1_700_000_000 + i, 5][len(more):])[:3]
        out += struct.pack(order + "IIII", sec, sub, len(data), original) + data
    return out


def pcapng(packets, link=1):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", link, 0, 0))
    for data in packets:
        us = 1_700_000_000_000_005
        out += block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(data), len(data)) + data + b"\0" * (-len(data) % 4))
    return out


def one(data):
    p = capture.read_packets(data)
    assert len(p) == 1
    return int(p.src_port[0]), int(p.dst_port[0]), int(p.proto[0]), int(p.length[0]), int(p.ts_us[0])


TCP, UDP, ICMP = (ipv4(6, body=ports(1234, 80)), ipv4(17, body=ports(53, 5353)), ipv4(1, body=b"\x08\0\0\0"))


def test_ethernet_tcp():
    assert one(pcap([(ether(TCP),)])) == (1234, 80, 6, len(ether(TCP)), 1_700_000_000_000_005)


def test_raw_udp_nanoseconds_big_endian():
    assert one(pcap([(UDP, len(UDP), 1_700_000_000, 123_456_999)], 101, ">", True)) == (53, 5353, 17, len(UDP), 1_700_000_000_123_456)


def test_icmp_has_no_ports():
    assert one(pcap([(ether(ICMP),)]))[:3] == (0, 0, 1)


def test_others_are_dropped_and_counted():
    v6 = b"\x60" + b"\0" * 39
    p = capture.read_packets(pcap([(ether(b"\0" * 28, 0x0806),), (ether(v6, 0x86DD),), (ether(ipv4(47, body=b"\0" * 8)),), (ether(TCP),), (ether(ipv4(17, body=ports(1, 2), fragment=100)),)]))
    assert len(p) == 1 and p.seen == {"records": 5, "ipv4": 3, "ipv6": 1, "kept": 1, "dropped": 4}


def test_cut_transport_header_keeps_ports():
    assert one(pcap([(ether(ipv4(6, body=ports(7, 8, b""))), 1500)]))[:4] == (7, 8, 6, 1500)


def test_vlan_null_and_cooked_links():
    assert one(pcap([(ether(UDP, tags=b"\x81\0\0\x05"),)]))[:2] == (53, 5353)
    assert one(pcap([(ether(UDP, tags=b"\x88\xa8\0\x05\x81\0\0\x06"),)]))[:2] == (53, 5353)
    assert one(pcap([(b"\x02\0\0\0" + UDP,)], 0))[:2] == (53, 5353)
    assert one(pcap([(b"\0" * 14 + b"\x08\0" + UDP,)], 113))[:2] == (53, 5353)


def test_zero_address_jumbo_and_order():
    p = capture.read_packets(pcap([(ether(ipv4(6, "0.0.0.0", body=ports(1, 2))), 70_000, 20, 0), (ether(TCP), 99, 10, 0)]))
    assert p.src_ip.tolist() == [0, 167772161] and p.length.tolist() == [70_000, 99] and p.ts_us.tolist() == [20_000_000, 10_000_000]


def test_empty_truncated_and_foreign_files():
    assert len(capture.read_packets(pcap([]))) == 0
    assert len(capture.read_packets(pcap([(ether(TCP),), (ether(UDP),)])[:-3])) == 1
    for data in (b"", b"hello world", pcap([])[:10]):
        with pytest.raises(capture.CaptureError):
            capture.read_packets(data)


def test_pcapng():
    assert one(pcapng([ether(UDP)])) == (53, 5353, 17, len(ether(UDP)), 1_700_000_000_000_005)


def test_written_records_read_back():
    cols = ([1, 2, 2**32 - 1], [4, 5, 6], [10, 65535, 0], [20, 80, 0], [6, 17, 1], [1500, 70_000, 64], [10**15 + 7, 10**15, 5])
    p = capture.read_packets(capture.FILE_HEADER + capture.packet_records(*cols))
    assert [c.tolist() for c in (p.src_ip, p.dst_ip, p.src_port, p.dst_port, p.proto, p.length, p.ts_us)] == [list(c) for c in cols]
    with pytest.raises(ValueError, match="TCP"):
        capture.packet_records([1], [1], [1], [1], [47], [1], [1])


def test_data_source_batch_and_stream(spark, tmp_path):
    register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pcap").write_bytes(pcap([(ether(TCP),), (ether(UDP),)]))
    (folder / "b.pcapng").write_bytes(pcapng([ether(ICMP)]))
    df = spark.read.format("pcap").load(str(folder))
    assert df.rdd.getNumPartitions() == 2 and df.count() == 3
    assert rows(df) == rows(read_pcap(spark, str(folder)))
    assert {r["path"][-6:]: (r["records"], r["kept"]) for r in capture_statistics(spark, str(folder)).collect()} == {"a.pcap": (2, 2), "pcapng": (1, 1)}
    store, progress = str(tmp_path / "store"), str(tmp_path / "progress")
    run = lambda: stream_ingest(stream_packets(spark, str(folder)), store, progress, {"availableNow": True}).awaitTermination()
    run()
    (folder / "c.pcap").write_bytes(pcap([(ether(UDP),)]))
    run()
    from packetlens.plans.store import read_store

    assert read_store(spark, store).df.count() == 4
    (folder / "d.pcap").write_bytes(b"broken")
    assert spark.read.format("pcap").option("ignoreCorrupt", "true").load(str(folder)).count() == 4


def read_part(part):
    return pcap_source.Reading({"path": part.path}).rows(part)


def many_packets(n, seed=5):
    """Packets of many sizes, some with what looks like a record header inside."""
    rng, fake = random.Random(seed), struct.pack("<IIII", 1_700_000_000, 5, 40, 40)
    return [(ether(ipv4(rng.choice([6, 17, 1]), body=ports(rng.randrange(65536), 80, bytes(rng.randrange(0, 900)) + rng.choice([b"", fake, fake * 3]) + rng.randbytes(9)))),) for _ in range(n)]


@pytest.mark.parametrize(("order", "nano", "overlap"), [("<", False, 4 << 20), (">", True, 4 << 20), ("<", False, 60_000)])
def test_splits_give_the_packets_of_the_whole_file(tmp_path, monkeypatch, order, nano, overlap):
    monkeypatch.setattr(capture, "OVERLAP", overlap)
    monkeypatch.setattr(pcap_source, "OVERLAP", overlap)
    path = tmp_path / "a.pcap"
    path.write_bytes(pcap(many_packets(1500), order=order, nano=nano) + b"\1" * 30)  # and a cut-off record
    whole = [r for b in read_part(pcap_source.FilePartition(str(path))) for r in b.to_pylist()]
    for size in (70_000, 200_000):
        parts = pcap_source.splits(str(path), size)
        got = [r for p in parts for b in read_part(p) for r in b.to_pylist()]
        assert len(parts) > 2 and len(whole) == 1500 and got == whole
    assert len(pcap_source.splits(str(path), 0)) == 1


def test_splits_that_do_not_meet_are_an_error(tmp_path, monkeypatch):
    path = tmp_path / "a.pcap"
    path.write_bytes(pcap(many_packets(600)))
    monkeypatch.setattr(capture, "first_record", lambda header, seconds, data, to_end: 7)
    with pytest.raises(capture.CaptureError, match="splitbytes=0"):
        list(read_part(pcap_source.splits(str(path), 50_000)[0]))


def test_split_option(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(many_packets(900)))
    register(spark)
    read = spark.read.format("pcap").option("splitbytes", "60000").load(str(tmp_path))
    assert read.rdd.getNumPartitions() > 3 and rows(read) == rows(read_pcap(spark, str(tmp_path / "a.pcap")))


# --- pcapng in parts ----------------------------------------------------------------------


def mixed_pcapng(rng, n, order="<"):
    """Sections of either byte order, interfaces of two link types and units anywhere, unknown blocks, packets that look like blocks."""
    out, links = b"", []

    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))

    for i in range(n):
        if i == 0 or rng.random() < 0.003:
            order, links = rng.choice("<>"), []
            out += block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
        if not links or rng.random() < 0.01:
            unit = rng.choice([6, 9, 0x80 | 20])
            links.append(rng.choice([1, 101]))
            out += block(1, struct.pack(order + "HHI", links[-1], 0, 0) + struct.pack(order + "HHBxxx", 9, 1, unit) + struct.pack(order + "HH", 0, 0))
        if rng.random() < 0.05:
            out += block(5, rng.randbytes(rng.randrange(0, 40)))
        where = rng.randrange(len(links))
        fake = struct.pack("<II", 6, 40) * 5
        data = ipv4(rng.choice([6, 17]), body=ports(rng.randrange(65536), i % 65536, fake[: rng.choice([0, 40])] + rng.randbytes(rng.randrange(0, 300))))
        data = ether(data) if links[where] == 1 else data
        ticks = 1_700_000_000_000_000 + rng.randrange(10**9)
        out += block(6, struct.pack(order + "IIIII", where, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pcapng_in_parts_equals_the_whole(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(capture, "OVERLAP", 40_000)
    monkeypatch.setattr(pcap_source, "OVERLAP", 40_000)
    path = tmp_path / "a.pcapng"
    path.write_bytes(mixed_pcapng(random.Random(seed), 1501)[: None if seed % 2 else -5])  # every other one with its last packet cut off
    whole = [r for b in read_part(pcap_source.FilePartition(str(path))) for r in b.to_pylist()]
    assert len(whole) == 1500 + seed % 2
    for size in (30_000, 111_111):
        found = []
        for a, b in pcap_source.block_parts(path.stat().st_size, path.stat().st_size // size):
            here, data = [], pcap_source.read_range(str(path), a, b - a + 80_000)
            capture.pcapng_split(data, a == 0, b - a, a + len(data) >= path.stat().st_size, found=here)
            found += [[a + x, *rest] for x, *rest in here]
        parts = pcap_source.splits(str(path), size, found)
        assert len(parts) > 2 and [r for p in parts for b in read_part(p) for r in b.to_pylist()] == whole


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_pcapng_parts_by_spark(spark, tmp_path, scheme):
    for i in range(2):
        (tmp_path / f"{i}.pcapng").write_bytes(mixed_pcapng(random.Random(i), 3000))
    (tmp_path / "c.pcap").write_bytes(pcap(many_packets(500)))
    path = scheme + str(tmp_path)
    tables = pcap_source.pcapng_tables(spark, path, 100_000)
    assert len(tables) == 2 and all(len(found) > 2 for found in tables.values())
    read = pcap_source.open_captures(spark, path, split_bytes=100_000)
    assert read.rdd.getNumPartitions() > 8 and rows(read) == rows(read_pcap(spark, path))


def test_ranges_of_remote_files(tmp_path):
    from packetlens.sources import ranges

    (tmp_path / "a.pcap").write_bytes(bytes(range(100)))
    uri = (tmp_path / "a.pcap").as_uri()
    remote = lambda path: ranges._remote(path)
    fs, inner = remote(uri)
    with fs.open_input_file(inner) as f:
        assert f.read_at(5, 90) == bytes(range(90, 95))
    assert ranges.read_range(uri, 10, 5) == bytes(range(10, 15)) and ranges.file_size(uri) == 100 and ranges.read_range(uri, 98) == b"bc"
    assert not ranges.reachable("unknown://host/a.pcap") and ranges.is_remote("s3://b/a") and not ranges.is_remote(uri)


# --- filters of raw frames and of columns -------------------------------------------------


def test_pushed_filters_reach_the_source(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(many_packets(900)))
    read = pcap_source.open_captures(spark, str(tmp_path))
    some = read.where("proto = 6 AND dst_port = 80 AND length > 300 AND NOT src_port <= 1000 AND src_port IN (%s) AND ts >= TIMESTAMP'2023-11-14 22:15:00'" % ", ".join(map(str, range(0, 65536, 7))))
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("BatchScan") :]
    assert "Filter" not in plan[: plan.index("BatchScan")] or "PushedFilters" in scan or "pushed" in scan.lower()
    plain = [r for r in read.collect() if r.proto == 6 and r.dst_port == 80 and r.length > 300 and not r.src_port <= 1000 and r.src_port % 7 == 0 and r.ts.timestamp() >= 1_700_000_100]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, plain)) and plain


def test_pushed_filter_semantics():
    from datetime import datetime, timezone

    from pyspark.sql import datasource as d

    (batch,) = read_part_of(pcap([(ether(TCP),), (ether(UDP),), (ether(ICMP),)]))
    at = lambda f: pcap_source.filter_mask(f, batch).tolist()
    assert at(d.EqualTo(("proto",), 6)) == [True, False, False] and at(d.Not(d.In(("proto",), (6, 1)))) == [False, True, False]
    second = datetime(2023, 11, 14, 22, 13, 21, 5, tzinfo=timezone.utc)
    assert at(d.GreaterThan(("ts",), second)) == [False, False, True] and at(d.LessThanOrEqual(("ts",), second)) == [True, True, False]
    assert at(d.IsNotNull(("ts",))) == [True] * 3
    assert not pcap_source.can_push(d.EqualTo(("proto",), "x")) and not pcap_source.can_push(d.IsNull(("proto",))) and pcap_source.can_push(d.Not(d.LessThan(("length",), 5)))


def read_part_of(data):
    return list(pcap_source.to_arrow(capture.read_packets(data)))


# --- pieces -------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [16, 40, 700, 5_000, 1 << 20])
def test_pieces_give_the_records_of_the_whole_file(tmp_path, monkeypatch, piece):
    from packetlens.sources.packet_filter import compile_packet_filter

    keep = compile_packet_filter("udp or less 300")
    monkeypatch.setattr(capture, "PIECE", piece)
    for name, data in {"a.pcap": pcap(many_packets(300)) + b"\1" * 30, "b.pcap": pcap(many_packets(300), order=">", nano=True)[:-7], "c.pcapng": mixed_pcapng(random.Random(7), 300), "d.pcapng": mixed_pcapng(random.Random(8), 300)[:-5], "e.pcap": pcap([])}.items():
        (tmp_path / name).write_bytes(data)
        for frames in ("false", "true"):
            whole = (capture.read_frames if frames == "true" else capture.read_packets)(data, keep)
            reading = pcap_source.Reading({"path": str(tmp_path / name), "capturefilter": "udp or less 300", "frames": frames})
            got = [r for b in reading.rows(pcap_source.FilePartition(str(tmp_path / name))) for r in b.to_pylist()]
            assert got == [r for b in pcap_source.to_arrow(whole) for r in b.to_pylist()] and (got or name == "e.pcap")
        counted = [r for b in pcap_source.Reading({"path": "", "counts": "true"}).rows(pcap_source.FilePartition(str(tmp_path / name))) for r in b.to_pylist()]
        assert [{c: r[c] for c in capture.read_packets(data).seen} for r in counted if r["records"] is not None] == [dict(capture.read_packets(data).seen)]


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_a_task_holds_a_piece_of_its_file(tmp_path, kind):
    import tracemalloc

    frame = ether(TCP)
    path = tmp_path / f"a.{kind}"
    path.write_bytes(pcap([(frame,)] * 2) + pcap([(frame,)])[24:] * 200_000 if kind == "pcap" else pcapng([frame]) + pcapng([frame])[48:] * 200_000)
    reading = pcap_source.Reading({"path": str(path), "capturefilter": "tcp and port 80"})
    tracemalloc.start()
    n = sum(b.num_rows for b in reading.rows(pcap_source.FilePartition(str(path))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == (200_002 if kind == "pcap" else 200_001) and peak < 50e6, peak


def test_statistics_read_ranges_of_large_files(spark, tmp_path):
    """A file is not read as one value, which Spark has a limit for, and the parts of one are counted apart."""
    (tmp_path / "a b.pcap").write_bytes(pcap(many_packets(900)))
    (tmp_path / "b.pcapng").write_bytes(mixed_pcapng(random.Random(3), 1500))
    (tmp_path / "c.pcap").write_bytes(pcap([]))
    (tmp_path / "unnamed").write_bytes(pcap([(ether(TCP),), (ether(UDP),)])[:-3])
    want = {f"file:{f}": capture.read_packets(f.read_bytes()).seen for f in tmp_path.iterdir()}
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "1000")
    try:
        for split in (pcap_source.SPLIT_BYTES, 60_000, 0):
            got = capture_statistics(spark, str(tmp_path), **({} if split == pcap_source.SPLIT_BYTES else {"split_bytes": split})).collect()
            assert {r["path"]: {n: r[n] for n in r.asDict() if n != "path"} for r in got} == {path: dict(seen) for path, seen in want.items()} and len(got) == 4
    finally:
        spark.conf.unset(limit)
    (tmp_path / "d.pcap").write_bytes(b"broken")
    with pytest.raises(Exception, match="neither pcap nor pcapng"):
        capture_statistics(spark, str(tmp_path)).collect()


def test_statistics_where_no_ranges_can_be_read(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pcap").write_bytes(pcap(many_packets(300)))
    (tmp_path / "b.pcapng").write_bytes(mixed_pcapng(random.Random(3), 300))
    want = rows(capture_statistics(spark, str(tmp_path)))
    monkeypatch.setattr(pcap_source, "is_remote", lambda path: True)
    monkeypatch.setattr(pcap_source, "reachable", lambda path: False)
    assert rows(capture_statistics(spark, str(tmp_path))) == want and len(want) == 2

import io
import os

import pytest
from conftest import rows

from packetlens import cli
from packetlens.metrics import store_size
from packetlens.operators.engine import PacketFrame
from packetlens.plans.store import read_store, unreadable, write_store
from packetlens.plans.session import checkpoint_folder
from packetlens.schema import PACKET_COLUMNS
from packetlens.sinks.files import csv_name, pcap_name, print_packets, write_aggregate, write_pcap
from packetlens.sources.capture import file_header, frame_records
from packetlens.sources.pcap import read_pcap
from packetlens.streaming.live import stream_ingest, stream_packets
from packetlens.testdata import packets


@pytest.fixture(scope="module")
def store(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    write_store(packets(spark, sf).select(*PACKET_COLUMNS), path)
    return path


FILTERS = ["", "ip.src == 10.0.0.1 || udp", "frame.time < Jan 5, 2024 00:00:00 || frame.time > Jan 25, 2024 00:00:00", "frame.time < Jan 25, 2024 00:00:00 || frame.time > Jan 5, 2024 00:00:00",
           "frame.time > Jan 5, 2024 00:00:00 && frame.time < Jan 6, 2024 00:00:00", "frame.time > Jan 9, 2024 00:00:00 && frame.time < Jan 6, 2024 00:00:00"]


@pytest.mark.parametrize("text", FILTERS)
def test_pruned_store_loses_no_rows(spark, sf, store, text):
    plain = PacketFrame(packets(spark, sf).select(*PACKET_COLUMNS)).filter(text).df
    assert rows(read_store(spark, store, text).df) == rows(plain)


def test_pruning_reaches_the_scan(spark, store):
    plan = read_store(spark, store, "ip.addr == 192.168.0.7 && frame.time < Jan 5, 2024 00:00:00").df._jdf.queryExecution().executedPlan().toString()
    assert "ts_date" in plan.split("PartitionFilters")[1].split("]")[0]
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "Or(EqualTo(src_ip" in pushed and "LessThan(ts" in pushed


def test_corrupt_files_are_skipped_when_asked_and_reported(spark, sf, tmp_path, capsys):
    path = str(tmp_path / "s")
    write_store(packets(spark, sf).select(*PACKET_COLUMNS), path)
    assert unreadable(read_store(spark, path)) is None
    (batch,) = [n for n in os.listdir(path) if n.startswith("batch=")]
    with open(os.path.join(path, batch, "ts_date=2024-01-05", "part-bad.parquet"), "wb") as f:
        f.write(b"no parquet")
    assert read_store(spark, path, ignore_corrupt=True).df.count() == 1000
    assert "part-bad" in unreadable(read_store(spark, path))
    assert cli.query(spark, ["-i", path, "-o", str(tmp_path), "-agOp", "count"]) == 0
    assert "part-bad" in capsys.readouterr().err


def test_size(spark, store):
    size, files = store_size(spark, store)
    assert size > 1000 and files > 1


def test_sinks(spark, store, tmp_path):
    frame = read_store(spark, store, "udp && frame.len < 60")
    out = io.StringIO()
    n = print_packets(frame, out)
    lines = out.getvalue().splitlines()
    assert len(lines) == n + 1 and lines[0].startswith("src IP (: port)          dst IP")
    times = [(int(x[68:83]), int(x[83:98])) for x in lines[1:]]
    assert times == sorted(times)
    path = str(tmp_path / pcap_name(frame))
    assert write_pcap(frame, path) == n
    assert rows(read_pcap(spark, path)) == rows(frame.df)
    written = write_aggregate(frame, str(tmp_path), "sum", "length", 86_400_000_000)
    assert os.path.basename(written) == csv_name(frame, "sum", "length", 86_400_000_000) == "((proto == 17 and length < 60))_sum_length_86400.000000secs.csv"
    with open(written) as f:
        text = f.read().splitlines()
    assert text[0] == "interval,sum_length" and [int(x.split(",")[0]) for x in text[1:]] == sorted(int(x.split(",")[0]) for x in text[1:])


def test_command_line(spark, sf, store, tmp_path, capsys):
    captures = tmp_path / "captures"
    captures.mkdir()
    write_pcap(PacketFrame(packets(spark, sf)), str(captures / "a.pcap"))
    out = str(tmp_path / "out")
    assert cli.ingest(spark, ["-f", str(captures), "-o", out, "-b", "-zzz"]) == 0
    line = capsys.readouterr().out.strip().split(";")
    assert len(line) == 13 and line[1:5] == [""] * 4 and line[9] == "1000" and float(line[11]) == int(line[10]) / 1000
    assert 0 < int(line[0]) < int(line[6]) and 0 < int(line[5]) < int(line[6])
    assert cli.ingest(spark, ["-f", str(captures), "-o", str(tmp_path / "again")]) == 0
    (captures / "b.pcap").write_bytes(b"no capture")
    v6 = b"\xaa" * 12 + b"\x86\xdd\x60" + bytes(39)
    (captures / "c.pcap").write_bytes(file_header(1) + frame_records([0, 1], [0, 0], [v6, bytes(30)]))
    assert cli.ingest(spark, ["-f", str(captures), "-o", str(tmp_path / "more")]) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[0].startswith("1000 packets") and "; 0 of 1000 records dropped, 0 of them IPv6; 0 files" in said[0]
    assert said[-1].startswith("1000 packets") and "; 2 of 1002 records dropped, 1 of them IPv6; 1 files" in said[-1]
    assert rows(read_store(spark, out).df) == rows(read_store(spark, store).df)
    results = str(tmp_path / "results")
    assert cli.query(spark, ["-i", out, "-o", results, "-f", "tcp", "&&", "frame.len", ">", "100", "||", "icmp", "-p", "-v", "-benchmark"]) == 0
    said = capsys.readouterr().out
    handling, writing, total = map(int, said.strip().splitlines()[-1].split(";"))
    assert "168 packets" in said and handling > 0 and writing > 0 and total == handling + writing
    assert cli.query(spark, ["-i", out, "-o", results, "-a", "-agOp", "max", "-intervall", "3600000000"]) == 0
    assert os.path.exists(capsys.readouterr().out.strip())
    assert cli.query(spark, ["-i", out, "-filter", "udp &&"]) == 1
    assert cli.query(spark, ["-i", out, "-agOp", "median"]) == 0
    assert cli.main([]) == 2


def test_batches_replace_themselves_and_add_to_others(spark, sf, tmp_path):
    path, some = str(tmp_path / "s"), packets(spark, sf).select(*PACKET_COLUMNS)
    for batch, n in (("a", 10), ("b", 5), ("a", 7)):
        write_store(some.limit(n), path, batch=batch, partitions=2)
    assert read_store(spark, path).df.count() == 12 and read_store(spark, path).df.columns == PACKET_COLUMNS


def test_a_stream_takes_files_whatever_their_names(spark, sf, tmp_path):
    captures, store, progress = tmp_path / "captures", str(tmp_path / "s"), str(tmp_path / "progress")
    captures.mkdir()
    for name, text in (("m.pcap", "udp"), ("a.pcap", "icmp"), ("z.pcap", "tcp")):
        write_pcap(PacketFrame(packets(spark, sf)).filter(text), str(captures / name))
        stream_ingest(stream_packets(spark, str(captures)), store, progress, {"availableNow": True}).awaitTermination()
    assert read_store(spark, store).df.count() == 1000


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        checkpoint_folder(Session())

"""The manifest: files skipped unopened, no packet lost; compaction that readers do not notice."""

import os
import random
import shutil
import threading

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_dsl import ROWS, evaluate, trees

from packetlens.operators.engine import PacketFrame
from packetlens.plans import dsl
from packetlens.plans import manifest as m
from packetlens.plans.store import compact_store, read_store, write_store
from packetlens.queries import _filled
from packetlens.schema import PACKET_COLUMNS
from packetlens.testdata import packets

ends = st.integers(0, 30)
sets = st.lists(st.tuples(ends, ends).map(lambda p: (min(p), max(p))), max_size=6)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(a=sets, b=sets)
def test_interval_algebra(a, b):
    a, b = dsl.union(a, []), dsl.union(b, [])
    points = lambda s: {x for low, high in s for x in range(low, high + 1)}
    for got, want in ((dsl.union(a, b), points(a) | points(b)), (dsl.intersection(a, b), points(a) & points(b))):
        assert points(got) == want and all(x[1] + 1 < y[0] for x, y in zip(got, got[1:])) and all(low <= high for low, high in got)
    for most in (1, 2, 3):
        some = dsl.fewer(dsl.union(a, b), most)
        assert len(some) <= most and points(some) >= points(a) | points(b)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(tree=trees(depth=4))
def test_intervals_and_hosts_are_sound(tree):
    times, hosts = dsl.time_intervals(tree), dsl.host_sets(tree)
    for row in ROWS:
        if evaluate(tree, row):
            assert any(low <= row[6] <= high for low, high in times)
            assert all({row[0], row[1]} & s for s in hosts)


@pytest.mark.parametrize(
    ("text", "days"),
    [
        ("frame.time < Jan 5, 2024 00:00:00 || frame.time > Jan 25, 2024 00:00:00", [*range(1, 6), *range(25, 31)]),
        ("frame.time > Jan 9, 2024 12:00:00 && frame.time < Jan 10, 2024 12:00:00 || udp && frame.time == Jan 20, 2024 00:00:00", [9, 10, 20]),
        ("frame.time < Jan 3, 2024 00:00:00 || frame.time > Jan 5, 2024 00:00:00 && frame.time < Jan 6, 2024 00:00:00 || frame.time > Jan 29, 2024 00:00:00", [1, 2, 3, 5, 6, 29, 30]),
        ("udp || frame.time < Jan 3, 2024 00:00:00", list(range(1, 31))),
    ],
)
def test_middle_dates_are_pruned(spark, text, days):
    tree = dsl.parse(text)
    test = dsl.date_predicate(tree)
    dates = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-30')) AS ts_date")
    got = [r[0].day for r in (dates if test is None else dates.where(test)).collect()]
    assert got == days


@pytest.fixture(scope="module")
def store(spark, sf):
    return _filled(spark, sf)


def test_partition_filters_are_disjoint(spark, store):
    plan = read_store(spark, store, "frame.time < Jan 5, 2024 00:00:00 || frame.time > Jan 25, 2024 00:00:00").df._jdf.queryExecution().executedPlan().toString()
    assert "OR" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_manifest_says_what_files_hold(spark, store):
    rows_ = {r["file"]: r for r in m.manifest(spark, store).collect()}
    files = read_store(spark, store).df.inputFiles()
    assert len(files) == len(rows_) > 30 and sum(r["packets"] for r in rows_.values()) == 1000
    some = random.Random(1).sample(sorted(rows_), 3)
    for name in some:
        at = spark.read.parquet(f"{store}/{name}")
        low, high, n = at.select(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count("*")).first()
        r = rows_[name]
        assert (r["low"], r["high"], r["packets"]) == (low, high, n) and r["bytes"] > 0
        hosts = {h for p in at.select("src_ip", "dst_ip").collect() for h in p}
        one = m.manifest(spark, store).where(F.col("file") == name)
        assert all(one.where(m._has(h)).count() == 1 for h in list(hosts)[:5])
        assert one.select(*[F.coalesce(m._has(h), F.lit(False)).alias(str(h)) for h in range(100, 150)]).first().asDict() == {str(h): False for h in range(100, 150)}


@pytest.mark.parametrize(
    ("text", "most"),
    [
        ("ip.addr == 192.168.0.7", 6),
        ("ip.src == 10.0.0.1 && frame.time < Jan 8, 2024 00:00:00", 12),
        ("frame.time < Jan 2, 2024 00:00:00 || frame.time > Jan 30, 2024 00:00:00", 8),
        ("ip.addr == 1.2.3.4", 0),
        ("frame.time > Jan 9, 2024 00:00:00 && frame.time < Jan 6, 2024 00:00:00", 0),
        ("udp || ip.src == 10.0.0.1", 10**6),
        ("", 10**6),
    ],
)
def test_files_are_skipped_unopened(spark, sf, store, text, most):
    frame = read_store(spark, store, text)
    everything = len(read_store(spark, store).df.inputFiles())
    assert len(frame.df.inputFiles()) <= min(most, everything) and (most < 100) == (len(frame.df.inputFiles()) < everything)
    assert rows(frame.df) == rows(PacketFrame(packets(spark, sf).select(*PACKET_COLUMNS)).filter(text).df)


def test_batches_without_a_manifest_are_read_whole(spark, sf, tmp_path):
    path, some = str(tmp_path / "s"), packets(spark, sf).select(*PACKET_COLUMNS)
    write_store(some.where("src_ip % 2 = 0"), path, batch="a", partitions=1)
    write_store(some.where("src_ip % 2 = 1"), path, batch="b", partitions=1)
    shutil.rmtree(tmp_path / "s" / "_manifest" / "a")
    assert read_store(spark, path).df.count() == 1000
    got = read_store(spark, path, "ip.src == 10.0.0.2")
    assert rows(got.df) == rows(PacketFrame(some).filter("ip.src == 10.0.0.2").df)
    shutil.rmtree(tmp_path / "s" / "_manifest")
    assert read_store(spark, path, "udp").df.count() == PacketFrame(some).filter("udp").df.count()
    write_store(some.where("false"), path, batch="c", partitions=1)
    assert read_store(spark, path).df.count() == 1000


def test_compaction_under_a_reader(spark, sf, tmp_path):
    path, some = str(tmp_path / "s"), packets(spark, sf).select(*PACKET_COLUMNS).cache()
    for i in range(8):
        write_store(some.where(F.pmod(F.xxhash64("src_port", "ts"), F.lit(8)) == i), path, batch=f"live-{i}", partitions=1)
    want, seen, stop = rows(some), [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(rows(read_store(spark, path).df) == want)

    reader = threading.Thread(target=read)
    reader.start()
    before = read_store(spark, path).df  # its files are settled now and stay readable until the vacuum
    files = len(before.inputFiles())
    try:
        assert compact_store(spark, path, partitions=1) == 8
        assert m.vacuum(spark, path) == 0
        assert rows(before) == want
    finally:
        stop.set()
        reader.join()
    assert seen and all(seen)
    after = read_store(spark, path).df
    assert rows(after) == want and len(after.inputFiles()) < files / 4
    assert compact_store(spark, path) == 0
    assert m.vacuum(spark, path, older_than_seconds=-1) == 8 and rows(read_store(spark, path).df) == want
    assert len([n for n in os.listdir(path) if n.startswith("batch=")]) == 1


def test_an_unfinished_compaction_is_not_seen(spark, sf, tmp_path):
    path, some = str(tmp_path / "s"), packets(spark, sf).select(*PACKET_COLUMNS)
    write_store(some, path, batch="a", partitions=1)
    shutil.copytree(tmp_path / "s" / "batch=a", tmp_path / "s" / "batch=compact-x")
    assert read_store(spark, path).df.count() == 1000
    assert m.vacuum(spark, path, older_than_seconds=-1) == 1 and os.path.exists(tmp_path / "s" / "batch=a")


def test_bins():
    sizes = [("a", 3, 10), ("b", 1, 60), ("c", 2, 50), ("d", 9, 200), ("e", 5, 30), ("f", 6, 99)]
    assert m.small_bins(sizes, 100) == [["c", "a", "e"]]
    assert m.small_bins(sizes, 5) == [] and m.small_bins([], 5) == []

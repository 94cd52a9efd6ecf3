"""Sessions, grouped vectors and bitmaps: brute force, late rows, state."""

import random

from conftest import rows
from pyspark.sql import functions as F

from packetlens.operators.engine import slot
from packetlens.operators.flows import FIVE_TUPLE, address_bitmaps, bitmap_counts, flow_sessions, merged_bitmaps, packet_groups, ungrouped
from packetlens.queries import DAY, HOUR
from packetlens.schema import PACKET_COLUMNS
from packetlens.streaming.live import stream_bitmaps, stream_sessions
from packetlens.testdata import packets

SCHEMA = "src_ip long, dst_ip long, src_port int, dst_port int, proto short, length int, us long"


def some(spark, n=600, seed=2):
    rng = random.Random(seed)
    data = [(rng.randrange(3), 9, 1000, rng.choice([80, 443]), 6, rng.choice([40, 50, 1500]), 1_700_000_000_000_000 + rng.randrange(200) * 1_000_000) for _ in range(n)]
    return data, spark.createDataFrame(data, SCHEMA).select("*", F.timestamp_micros("us").alias("ts")).drop("us")


def test_sessions_and_groups_equal_brute_force(spark):
    data, df = some(spark)
    idle, size = 3_000_000, 7
    flows: dict = {}
    for *key, length, us in data:
        flows.setdefault(tuple(key), []).append((us, length))
    sessions, groups = [], []
    for key, items in flows.items():
        items.sort()
        run = []
        for at, x in enumerate(items):
            run.append(x)
            if at + 1 == len(items) or items[at + 1][0] - x[0] > idle:
                sessions.append((*key, len(run), sum(n for _, n in run), run[0][0], run[-1][0]))
                groups += [(*key, part[0][0], len(part), tuple((us - part[0][0], n) for us, n in part)) for part in (run[i : i + size] for i in range(0, len(run), size))]
                run = []
    got = flow_sessions(df, idle_us=idle).select(*FIVE_TUPLE, "packets", "bytes", "first_us", "last_us")
    assert sorted(map(tuple, got.collect())) == sorted(sessions) and len(sessions) > len(flows)
    made = packet_groups(df, idle_us=idle, size=size, slot_us=10**15)
    assert sorted((*r[:7], tuple(map(tuple, r["items"]))) for r in made.collect()) == sorted(groups)


def test_groups_are_bounded_and_lose_nothing(spark):
    _, df = some(spark, 2000)
    for size, slot_us in ((32, HOUR), (3, 7_000_000)):
        made = packet_groups(df, size=size, slot_us=slot_us)
        assert made.agg(F.max("packets")).first()[0] <= size
        spans = made.select(F.max("first_us"), F.bool_and(F.expr(f"first_us div {slot_us} = (first_us + items[packets - 1].offset_us) div {slot_us}"))).first()
        assert spans[1]
        assert rows(ungrouped(made).select(*df.columns)) == rows(df)
    assert packet_groups(df.where("false")).count() == 0 and ungrouped(packet_groups(df.where("false"))).count() == 0


def _stream(spark, folder, schema, make, out, progress):
    query = make(spark.readStream.schema(schema).parquet(folder)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", progress)
    query.trigger(availableNow=True).start().awaitTermination()


def test_finished_sessions_are_appended_once_and_late_packets_dropped(spark, tmp_path):
    base = 1_700_000_000
    folder, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    schema = some(spark, 1)[1].schema

    def add(*seconds):
        df = spark.createDataFrame([(1, 2, 3, 4, 6, 100, (base + s) * 1_000_000) for s in seconds], SCHEMA).select("*", F.timestamp_micros("us").alias("ts")).drop("us")
        df.coalesce(1).write.mode("append").parquet(folder)
        _stream(spark, folder, schema, lambda p: stream_sessions(p, idle_us=10_000_000, watermark="20 seconds"), out, progress)
        return sorted(((r["first_us"] // 10**6 - base, r["last_us"] // 10**6 - base, r["packets"]) for r in spark.read.schema("first_us long, last_us long, packets long").parquet(out).collect()) if (tmp_path / "out").exists() else [])

    assert add(0, 5, 12) == []
    assert add(100) == [(0, 12, 3)]  # the watermark is at 80 now
    assert add(8, 85, 95) == [(0, 12, 3)]  # 8 is late, 85 and 95 join the session of 100
    assert add(300) == [(0, 12, 3), (85, 100, 3)]


def test_hours_add_up_to_days_exactly(spark, sf):
    df = packets(spark, sf)
    hours = address_bitmaps(df, "src_ip", slot(interval=HOUR))
    assert hours.agg(F.max(F.length("bitmap"))).first()[0] <= 4096
    want = rows(df.groupBy(slot(interval=DAY).alias("interval")).agg(F.count_distinct("src_ip").alias("n")))
    assert rows(bitmap_counts(merged_bitmaps(hours, DAY), "n")) == want
    edge = spark.createDataFrame([(0, 0), (0, 2**32 - 1), (0, 2**32 - 1), (0, 32767), (0, 32768), (5, 1)], "t long, src_ip long").withColumn("ts", F.timestamp_micros("t"))
    assert rows(bitmap_counts(address_bitmaps(edge, "src_ip", slot(interval=5)), "n")) == [(0, 4), (5, 1)]


def test_streamed_bitmaps_are_appended_with_a_watermark(spark, sf, tmp_path):
    folder = str(tmp_path / "in")
    df = packets(spark, sf).select(*PACKET_COLUMNS)
    df.write.parquet(folder)
    _stream(spark, folder, df.schema, lambda p: stream_bitmaps(p, "v4Src", DAY, "1 hour"), str(tmp_path / "out"), str(tmp_path / "progress"))
    got = rows(bitmap_counts(spark.read.parquet(str(tmp_path / "out")), "n"))
    want = rows(df.groupBy(slot(interval=DAY).alias("interval")).agg(F.count_distinct("src_ip").alias("n")))
    assert len(got) >= 28 and got == want[: len(got)]

"""The query registry of the packet engine, with hand-written DuckDB SQL for each query."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.functions.ip import ip_to_long, long_to_ip, packet_text
from packetlens.operators.engine import PacketFrame, slot
from packetlens.operators.flows import address_bitmaps, bitmap_counts, flow_rollup, flow_sessions, host_clusters, merged_bitmaps, packet_groups, ungrouped
from packetlens.plans import dsl
from packetlens.plans.manifest import vacuum
from packetlens.plans.store import compact_store, read_store, shared_path, write_store
from packetlens.schema import AGGREGATE_FIELDS, PACKET_COLUMNS
from packetlens.sinks.files import console_rows, csv_name, pcap_name, write_pcap
from packetlens.sources.pcap import capture_statistics, local_path, open_captures, register
from packetlens.streaming.live import stream_aggregate, stream_bitmaps, stream_ingest, stream_packets, stream_sessions
from packetlens.testdata import FRAME_FIELDS, frames, packets, packets_cte

HOUR, DAY = 3_600_000_000, 86_400_000_000
ROW = ["event_id", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "length", "ts_us"]
JAN15 = 1705276800000000

#: name -> (filter, predicate in SQL, written by hand)
FILTERS = {
    "scan_all": ("", "TRUE"),
    "filter_ip_src_eq": ("ip.src == 10.0.0.1", "src_ip = 167772161"),
    "filter_ip_src_ne": ("ip.src != 10.0.0.1 && udp", "src_ip <> 167772161 AND proto = 17"),
    "filter_ip_src_lt": ("ip.src < 10.0.0.50", "src_ip < 167772210"),
    "filter_ip_src_gt": ("ip.src > 192.168.0.100", "src_ip > 3232235620"),
    "filter_ip_src_le": ("ip.src <= 10.0.0.50", "src_ip <= 167772210"),
    "filter_ip_src_ge": ("ip.src >= 192.168.0.100", "src_ip >= 3232235620"),
    "filter_ip_dst_eq": ("ip.dst == 192.168.0.7", "dst_ip = 3232235527"),
    "filter_ip_dst_ne": ("ip.dst != 192.168.0.7", "dst_ip <> 3232235527"),
    "filter_ip_addr_eq": ("ip.addr == 192.168.0.7", "(src_ip = 3232235527 OR dst_ip = 3232235527)"),
    "filter_ip_addr_ne": ("ip.addr != 10.0.0.1", "(src_ip <> 167772161 OR dst_ip <> 167772161)"),
    "filter_ip_addr_ge": ("ip.addr >= 192.168.0.249", "(src_ip >= 3232235769 OR dst_ip >= 3232235769)"),
    "filter_ip_addr_ne_udp": ("ip.addr != 10.0.0.1 && udp", "(src_ip <> 167772161 OR dst_ip <> 167772161) AND proto = 17"),
    "filter_port_eq": ("port == 443 && frame.len < 60", "(src_port = 443 OR dst_port = 443) AND length < 60"),
    "filter_port_ne": ("port != 443", "(src_port <> 443 OR dst_port <> 443)"),
    "filter_port_zero": ("port == 0", "(src_port = 0 OR dst_port = 0)"),
    "filter_port_any": ("port >= 0", "TRUE"),
    "filter_port_src_ge": ("port.src >= 1024", "src_port >= 1024"),
    "filter_port_dst_lt": ("port.dst < 100", "dst_port < 100"),
    "filter_ports": ("port.src >= 1024 && port.dst < 100", "src_port >= 1024 AND dst_port < 100"),
    "filter_proto_eq": ("proto == 17", "proto = 17"),
    "filter_proto_ne": ("proto != 6", "proto <> 6"),
    "filter_tcp": ("tcp", "proto = 6"),
    "filter_udp": ("UDP", "proto = 17"),
    "filter_icmp": ("Icmp", "proto = 1"),
    "filter_len_lt": ("frame.len < 60", "length < 60"),
    "filter_len_eq": ("frame.len == 60", "length = 60"),
    "filter_len_le_big": ("frame.len <= 99999999", "length <= 99999999"),
    "filter_time_lt": ("frame.time < Jan 15, 2024 00:00:00", f"ts_us < {JAN15}"),
    "filter_time_gt": ("frame.time > Jan 15, 2024 00:00:00", f"ts_us > {JAN15}"),
    "filter_time_le": ("frame.time <= jan 15, 2024 00:00:00", f"ts_us <= {JAN15}"),
    "filter_time_ge": ("frame.time >= Jan 15, 2024 00:00:00", f"ts_us >= {JAN15}"),
    "filter_time_eq": ("frame.time == Jan 15, 2024 00:00:00", f"ts_us = {JAN15}"),
    "filter_time_ne": ("frame.time != Jan 15, 2024 00:00:00", f"ts_us <> {JAN15}"),
    "filter_time_range": ("frame.time >= Jan 10, 2024 00:00:00 && frame.time < Jan 15, 2024 12:30:00", f"ts_us >= 1704844800000000 AND ts_us < {JAN15 + 45_000_000_000}"),
    "filter_time_disjoint": ("frame.time < Jan 5, 2024 00:00:00 || frame.time > Jan 25, 2024 00:00:00", "(ts_us < 1704412800000000 OR ts_us > 1706140800000000)"),
    "filter_and_or_nesting": ("tcp && frame.len > 100 || icmp", "proto = 6 AND (length > 100 OR proto = 1)"),
    "filter_or_and_nesting": ("icmp || udp && frame.len < 60", "proto = 1 OR (proto = 17 AND length < 60)"),
    "filter_and_or_last": ("udp && frame.len < 60 || icmp", "proto = 17 AND (length < 60 OR proto = 1)"),
    "filter_ip_or_proto": ("ip.src == 10.0.0.1 || udp", "src_ip = 167772161 OR proto = 17"),
    "filter_no_spaces": ("ip.addr != 10.0.0.1 && udp ||tcp", "(src_ip <> 167772161 OR dst_ip <> 167772161) AND (proto = 17 OR proto = 6)"),
    "filter_vcomplex": (
        "port >= 0 && ip.addr != 10.0.0.9 && frame.len <= 99999999 && frame.time > Jan 1, 2024 00:00:00 || icmp",
        "(src_ip <> 167772169 OR dst_ip <> 167772169) AND length <= 99999999 AND (ts_us > 1704067200000000 OR proto = 1)",
    ),
}

_SQL_FIELDS = {"v4Src": "src_ip", "v4Dst": "dst_ip", "portSrc": "src_port", "portDst": "dst_port", "protocol": "proto", "length": "length"}
_SQL_OPERATORS = {
    "sum": "CAST(sum({0}) AS BIGINT)", "mean": "CAST(sum({0}) // count(*) AS BIGINT)", "min": "CAST(min({0}) AS BIGINT)",
    "max": "CAST(max({0}) AS BIGINT)", "count": "count(*)", "count_dist": "count(DISTINCT {0})",
}


def _with(sql: str) -> str:
    return f"WITH {packets_cte()} {sql}"


def _rows_sql(where: str) -> str:
    return _with(f"SELECT {', '.join(ROW)} FROM packets WHERE {where}")


def _aggregate_sql(op: str, field: str, interval: int, where: str = "TRUE") -> str:
    value = _SQL_OPERATORS[op].format(_SQL_FIELDS[field])
    return _with(f"SELECT (ts_us // {interval}) * {interval} AS interval, {value} AS {op}_{field} FROM packets WHERE {where} GROUP BY 1")


def filtered(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PacketFrame(packets(spark, sf_dir)).filter(text).df.select(*ROW)


def aggregated(op: str, field: str, interval: int, text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PacketFrame(packets(spark, sf_dir)).filter(text).aggregate(op, field, interval)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregated("sum", "length", DAY, "tcp && frame.len > 100 || icmp", spark, sf_dir)


# --- through the store, capture files and streams ---------------------------------------------

PACKET_SQL = "src_ip, dst_ip, src_port, dst_port, proto, length, ts_us"


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "store")
    write_store(packets(spark, sf_dir).select(*PACKET_COLUMNS), path)
    return path


#: A filter whose hosts and times are in few of a store's files.
MANIFEST_HOST = ("ip.addr == 192.168.0.7 && frame.time >= Jan 10, 2024 00:00:00 || ip.src == 10.0.0.1", "(src_ip = 3232235527 OR dst_ip = 3232235527) AND (ts_us >= 1704844800000000 OR src_ip = 167772161)")
#: Batches of a store that is filled day by day.
WEEKS = 5


def _filled(spark: SparkSession, sf_dir: str) -> str:
    """A store of a batch for each week, hosts of even and odd address apart."""
    path, rows = shared_path(spark, "store"), packets(spark, sf_dir)
    first = F.lit(1704067200000000)
    week = F.least(F.call_function("div", F.unix_micros("ts") - first, F.lit(7 * DAY)), F.lit(WEEKS - 1))
    for w in range(WEEKS):
        for odd in (0, 1):
            write_store(rows.where((week == w) & (F.col("dst_ip") % 2 == odd)).select(*PACKET_COLUMNS), path, partitions=2)
    return path


def filled_store(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter over a store of several batches, of which the manifest leaves some files."""
    return _plain(read_store(spark, _filled(spark, sf_dir), text).df)


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packets of a store whose batches were compacted and removed."""
    path = _filled(spark, sf_dir)
    compact_store(spark, path)
    vacuum(spark, path, older_than_seconds=0)
    return _plain(read_store(spark, path).df)


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in PACKET_COLUMNS if c != "ts"], F.unix_micros("ts").alias("ts_us"))


def store_filtered(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(read_store(spark, _stored(spark, sf_dir), text).df)


def pcap_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = local_path(shared_path(spark, "captures"))
    packets(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in _schema()]).write.format("pcap").mode("append").save(path)
    return _plain(spark.read.format("pcap").load(path))


def single_file(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of a filter through one capture file."""
    register(spark)
    path = local_path(shared_path(spark, "found")) + ".pcap"
    write_pcap(PacketFrame(packets(spark, sf_dir)).filter(text), path)
    return _plain(spark.read.format("pcap").load(path))


def _schema():
    from packetlens.schema import PACKET_SCHEMA

    return PACKET_SCHEMA.fields


def stream_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures -> stream -> store, and the store's rows."""
    register(spark)
    captures, store = local_path(shared_path(spark, "captures")), shared_path(spark, "store")
    packets(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in _schema()]).write.format("pcap").mode("append").save(captures)
    query = stream_ingest(stream_packets(spark, captures), store, shared_path(spark, "progress"), {"availableNow": True})
    query.awaitTermination()
    return _plain(read_store(spark, store).df)


def stored_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that got TCP packets from capture files and the others from a live stream."""
    register(spark)
    files, live, store = local_path(shared_path(spark, "captures")), local_path(shared_path(spark, "captures")), shared_path(spark, "store")
    rows = packets(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in _schema()])
    rows.where("proto = 6").write.format("pcap").mode("append").save(files)
    rows.where("proto != 6").write.format("pcap").mode("append").save(live)
    write_store(open_captures(spark, files), store)
    stream_ingest(stream_packets(spark, live), store, shared_path(spark, "progress"), {"availableNow": True}).awaitTermination()
    return _plain(read_store(spark, store).df)


def uncompressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "store")
    write_store(packets(spark, sf_dir).select(*PACKET_COLUMNS), path, compression="uncompressed")
    return _plain(read_store(spark, path).df)


def counted_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet classes of all captures together."""
    register(spark)
    path = local_path(shared_path(spark, "captures"))
    packets(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in _schema()]).write.format("pcap").mode("append").save(path)
    names = ["records", "ipv4", "ipv6", "kept", "dropped"]
    return capture_statistics(spark, path).agg(*[F.sum(n).alias(n) for n in names])


#: Filters of raw captures: text, predicate in SQL over packets and their frames' fields, whether whole frames are asked for.
RAW_FILTERS = {
    "capture_raw_flags": ("tcp[tcpflags] & (tcp-syn|tcp-ack) = tcp-syn and vlan", "NOT v6 AND proto = 6 AND flags & 18 = 2 AND vid >= 0", False),
    "capture_raw_vlan": ("vlan 101 or (vlan 103 and ip[8] > 60) and not icmp", "NOT v6 AND (vid = 101 OR vid = 103 AND ttl > 60) AND proto <> 1", False),
    "capture_raw_ipv6": ("ip6 and (udp dst port 53 or icmp6) and ip6[7] - 32 < 48", "v6 AND (proto = 17 AND dst_port = 53 OR proto = 1) AND ttl - 32 < 48", True),
    "capture_raw_payload": ("ip6 net 2001:db8::/32 and tcp and tcp[4:4] % 10 >= 5 or src net 192.168 and len > 200", "(v6 AND proto = 6 AND event_id % 10 >= 5 OR NOT v6 AND src_ip BETWEEN 3232235520 AND 3232301055) AND length > 100", True),
}


def raw_captured(text: str, whole: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ethernet captures of the packets, filtered by what only the frames hold."""
    register(spark)
    path = local_path(shared_path(spark, "captures"))
    frames(spark, sf_dir).write.format("pcap").mode("append").save(path)
    found = open_captures(spark, path, capture_filter=text, frames=whole)
    return found.select(F.unix_micros("ts").alias("ts_us"), "length", F.length("frame").alias("captured")) if whole else _plain(found)


def _raw_sql(where: str, whole: bool) -> str:
    size = "14 + CASE WHEN vid >= 0 THEN 4 ELSE 0 END + CASE WHEN v6 THEN 40 ELSE 20 END + CASE proto WHEN 6 THEN 20 ELSE 8 END"
    columns = f"ts_us, length + 100 AS length, {size} AS captured" if whole else "src_ip, dst_ip, src_port, dst_port, proto, length + 100 AS length, ts_us"
    return _with(f"SELECT {columns} FROM (SELECT *, {FRAME_FIELDS} FROM packets) WHERE {where}")


def pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of columns that the capture source tests itself."""
    register(spark)
    path = local_path(shared_path(spark, "captures"))
    packets(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in _schema()]).write.format("pcap").mode("append").save(path)
    return _plain(PacketFrame(open_captures(spark, path)).filter("proto != 1 && frame.len > 60 && port.dst == 443 && frame.time >= Jan 10, 2024 00:00:00").df)


#: Streaming aggregates beside the sum of lengths: operator, field, window and slide in microseconds.
STREAMS = {
    "stream_agg": ("sum", "length", HOUR, None),
    "stream_agg_mean": ("mean", "length", DAY, None),
    "stream_agg_max": ("max", "portSrc", DAY, None),
    "stream_agg_count": ("count", "protocol", HOUR // 2, None),
    "stream_agg_count_dist": ("count_dist", "v4Src", DAY, None),
    "stream_agg_sliding": ("sum", "length", DAY, DAY // 4),
}


def stream_aggregated(op: str, field: str, interval: int, slide: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream of packets aggregated by windows, in complete mode."""
    source, out = shared_path(spark, "packets"), shared_path(spark, "windows")
    packets(spark, sf_dir).select(*PACKET_COLUMNS).write.parquet(source)
    schema = spark.read.parquet(source).schema
    windows = stream_aggregate(spark.readStream.schema(schema).parquet(source), op, field, interval, slide=slide)
    write = lambda df, _: df.write.mode("overwrite").parquet(out)
    query = windows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def _stream_sql(op: str, field: str, interval: int, slide: int | None) -> str:
    if slide is None:
        return _aggregate_sql(op, field, interval)
    value = _SQL_OPERATORS[op].format(_SQL_FIELDS[field])
    slots = f"unnest(range((ts_us // {slide}) * {slide} - {interval - slide}, ts_us + 1, {slide}))"
    return _with(f"SELECT interval, {value} AS {op}_{field} FROM (SELECT *, {slots} AS interval FROM packets) GROUP BY 1")


#: A service's traffic: flows of many packets; sessions end after a quarter of an hour.
SERVICE, SERVICE_IDLE, LATE = ["dst_port", "proto"], HOUR // 4, "1 hour"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_sessions(packets(spark, sf_dir), SERVICE, SERVICE_IDLE)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped packet vectors of services, arrays as text."""
    made = packet_groups(packets(spark, sf_dir).select(*SERVICE, "length", "ts"), SERVICE, SERVICE_IDLE, size=4, slot_us=DAY)
    text = lambda c: F.array_join(F.transform("items", lambda x: x[c].cast("string")), ",").alias(c)
    return made.select(*SERVICE, "first_us", "packets", text("offset_us"), text("length"))


def groups_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packets through grouped vectors of their flows and services."""
    rows = packets(spark, sf_dir).select(*PACKET_COLUMNS)
    return _plain(ungrouped(packet_groups(ungrouped(packet_groups(rows)), SERVICE, SERVICE_IDLE)))


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished sessions of a stream in append mode."""
    source, out = shared_path(spark, "packets"), shared_path(spark, "sessions")
    packets(spark, sf_dir).select(*PACKET_COLUMNS).write.parquet(source)
    found = stream_sessions(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), SERVICE, SERVICE_IDLE, LATE)
    query = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


def distinct_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of each day, from the bitmaps of its hours."""
    return bitmap_counts(merged_bitmaps(address_bitmaps(packets(spark, sf_dir), "src_ip", slot(interval=HOUR)), DAY), "count_dist_v4Src")


def distinct_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct destinations of each day of a stream, from bitmaps in its state."""
    source, out = shared_path(spark, "packets"), shared_path(spark, "bitmaps")
    packets(spark, sf_dir).select(*PACKET_COLUMNS).write.parquet(source)
    bitmaps = stream_bitmaps(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), "v4Dst", DAY)
    write = lambda df, _: df.write.mode("overwrite").parquet(out)
    query = bitmaps.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return bitmap_counts(spark.read.parquet(out), "count_dist_v4Dst")


def _sessions_sql(where: str = "TRUE") -> str:
    keys = ", ".join(SERVICE)
    return _with(
        f"SELECT {keys}, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM ("
        f" SELECT *, sum(pause) OVER (PARTITION BY {keys} ORDER BY ts_us, event_id) AS session FROM ("
        f"  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {keys} ORDER BY ts_us, event_id) > {SERVICE_IDLE} THEN 1 ELSE 0 END AS pause FROM packets))"
        f" GROUP BY {keys}, session HAVING {where}"
    )


def _groups_sql() -> str:
    keys, flow = ", ".join(SERVICE), f"PARTITION BY {', '.join(SERVICE)}, day"
    return _with(
        f"SELECT {keys}, min(ts_us) AS first_us, count(*) AS packets, string_agg(CAST(ts_us - first AS VARCHAR), ',' ORDER BY n) AS offset_us, string_agg(CAST(length AS VARCHAR), ',' ORDER BY n) AS length FROM ("
        f" SELECT *, min(ts_us) OVER ({flow}, session, part) AS first FROM ("
        f"  SELECT *, (n - min(n) OVER ({flow}, session)) // 4 AS part FROM ("
        f"   SELECT *, sum(pause) OVER ({flow} ORDER BY n) AS session FROM ("
        f"    SELECT *, row_number() OVER ({flow} ORDER BY ts_us, length) AS n, CASE WHEN ts_us - lag(ts_us) OVER ({flow} ORDER BY ts_us, length) > {SERVICE_IDLE} THEN 1 ELSE 0 END AS pause"
        f"    FROM (SELECT *, ts_us // {DAY} AS day FROM packets)))))"
        f" GROUP BY {keys}, day, session, part"
    )


#: Filters and aggregates in compatibility mode.
COMPAT_FILTERS = {
    "compat_ip_lt": ("ip.src < 10.0.0.50", "{src} < {limit}"),
    "compat_port_cut": ("port.src == 65979", "src_port = 443"),
    "compat_len_cut": ("frame.len > 65600", "length > 64"),
    "compat_proto_cut": ("proto == 273", "proto = 17"),
    "compat_time_gt": ("frame.time > Jan 15, 2024 00:00:00", f"ts_us >= {JAN15}"),
    "compat_time_le": ("frame.time <= Jan 15, 2024 00:00:00", f"ts_us < {JAN15 + 1_000_000}"),
}


def compat_filtered(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PacketFrame(packets(spark, sf_dir), compat=True).filter(text).df.select(*ROW)


def compat_summed(op: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PacketFrame(packets(spark, sf_dir), compat=True).aggregate(op, "v4Dst", DAY)


#: Capture filters: text, predicate in SQL.
CAPTURE_FILTERS = {
    "capture_filter_ports": ("tcp port 80 or 443", "proto = 6 AND (src_port IN (80, 443) OR dst_port IN (80, 443))"),
    "capture_filter_left_to_right": ("icmp or udp and less 60", "(proto = 1 OR proto = 17) AND length <= 60"),
    "capture_filter_not_net": ("not (src net 10.0.0.0/26 or dst net 192.168) and greater 70", "NOT (src_ip BETWEEN 167772160 AND 167772223 OR dst_ip BETWEEN 3232235520 AND 3232301055) AND length >= 70"),
    "capture_filter_hosts": ("host 192.168.0.7 and src or dst portrange 50-100", "(src_ip = 3232235527 OR dst_ip = 3232235527) AND proto IN (6, 17) AND (src_port BETWEEN 50 AND 100 OR dst_port BETWEEN 50 AND 100)"),
}


def captured(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PacketFrame(packets(spark, sf_dir)).capture_filter(text).df.select(*ROW)


_SWAPPED = "((({0}) % 256) * 16777216 + (({0}) // 256 % 256) * 65536 + (({0}) // 65536 % 256) * 256 + ({0}) // 16777216)"


def optioned(how: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PacketFrame(packets(spark, sf_dir)).filter("ip.addr == 192.168.0.7").aggregate("mean", "length", HOUR, **how)


#: Filter -> canonical text and predicate in SQL, written by hand.
CANONICAL = {
    "": ("()", "TRUE"),
    "udp": ("(proto == 17)", "proto = 17"),
    "ip.addr == 88.221.154.110": ("(ip.addr == 88.221.154.110)", "src_ip = 1490918254 OR dst_ip = 1490918254"),
    "ip.addr != 10.0.0.1 && udp": ("((ip.addr != 10.0.0.1 and proto == 17))", "(src_ip <> 167772161 OR dst_ip <> 167772161) AND proto = 17"),
    "icmp || udp && frame.len < 60": ("((proto == 1 or (proto == 17 and length < 60)))", "proto = 1 OR (proto = 17 AND length < 60)"),
    "frame.time < Jan 15, 2024 00:00:00": ("(frame.time: < 1705276800 0)", f"ts_us < {JAN15}"),
    "ip.addr != 10.0.0.1 && udp ||tcp": ("((ip.addr != 10.0.0.1 and (proto == 17 or proto == 6)))", "(src_ip <> 167772161 OR dst_ip <> 167772161) AND (proto = 17 OR proto = 6)"),
}


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text of filters, the names of the series and captures made from them, and how many packets these have."""
    frame = PacketFrame(packets(spark, sf_dir))
    made = [frame.filter(text) for text in CANONICAL]
    counts = frame.df.agg(*[F.count_if(dsl.compile_filter(dsl.parse(text))).alias(f"f{i}") for i, text in enumerate(CANONICAL)])
    names = ("filter", "canonical", "csv", "pcap", "packets")
    rows = [(F.lit(t), F.lit(f.canonical()), F.lit(csv_name(f, "sum", "length", HOUR)), F.lit(pcap_name(f)), F.col(f"f{i}")) for i, (t, f) in enumerate(zip(CANONICAL, made, strict=True))]
    return counts.select(F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(r, names, strict=True)]) for r in rows])).alias("r")).select("r.*")


def console(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console_rows(packets(spark, sf_dir))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses to text and back."""
    shown = packets(spark, sf_dir).select("event_id", long_to_ip(F.col("src_ip")).alias("src"), long_to_ip(F.col("dst_ip")).alias("dst"))
    return shown.select("event_id", "src", ip_to_long(F.col("src")).alias("src_ip"), "dst", ip_to_long(F.col("dst")).alias("dst_ip"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).select("event_id", packet_text().alias("packet"))


_IP = "concat_ws('.', {0} // 16777216, {0} // 65536 % 256, {0} // 256 % 256, {0} % 256)"
_END = "CASE WHEN proto IN (6, 17) THEN " + _IP + " || ' : ' || {1} ELSE " + _IP + " END"


def queries() -> dict:
    out = {name: partial(filtered, text) for name, (text, _) in FILTERS.items()}
    for op in _SQL_OPERATORS:
        for field in AGGREGATE_FIELDS:
            out[f"agg_{op}_{field}"] = partial(aggregated, op, field, DAY, "")
    out |= {
        "agg_interval_1s": partial(aggregated, "sum", "length", 1_000_000, ""),
        "agg_interval_1h": partial(aggregated, "sum", "length", HOUR, ""),
        "agg_interval_1d": partial(aggregated, "sum", "length", DAY, ""),
        "agg_filtered": flagship,
        "console_rows": console,
        "address_text": addresses,
        "packet_text": texts,
        "store_roundtrip": partial(store_filtered, ""),
        "filter_ip_or_proto_store": partial(store_filtered, "ip.src == 10.0.0.1 || udp"),
        "filter_time_disjoint_store": partial(store_filtered, FILTERS["filter_time_disjoint"][0]),
        "filter_time_range_store": partial(store_filtered, FILTERS["filter_time_range"][0]),
        "store_manifest_host": partial(filled_store, MANIFEST_HOST[0]),
        "store_disjoint_pruned": partial(filled_store, FILTERS["filter_time_disjoint"][0]),
        "store_compacted": compacted,
        "pcap_roundtrip": pcap_roundtrip,
        "pcap_single_file": partial(single_file, ""),
        "pcap_single_file_filtered": partial(single_file, FILTERS["filter_or_and_nesting"][0]),
        "stream_ingest": stream_ingested,
        "store_mixed_ingest": stored_both_ways,
        "store_uncompressed": uncompressed,
        "capture_statistics": counted_captures,
        "canonical_names": canonical_names,
        "agg_fill_gaps": partial(optioned, {"fill_gaps": True}),
        "agg_exact_mean": partial(optioned, {"exact_mean": True}),
        "flow_rollup": lambda spark, d: flow_rollup(packets(spark, d)),
        "host_clusters": lambda spark, d: host_clusters(packets(spark, d)),
        "flow_sessions": sessions,
        "gpv_groups": groups,
        "gpv_roundtrip": groups_and_back,
        "stream_flow_sessions": streamed_sessions,
        "distinct_bitmap_days": distinct_days,
        "stream_distinct_bitmap": distinct_streamed,
    }
    out |= {name: partial(stream_aggregated, *how) for name, how in STREAMS.items()}
    out |= {name: partial(compat_filtered, text) for name, (text, _) in COMPAT_FILTERS.items()}
    out |= {f"compat_{op}_v4Dst": partial(compat_summed, op) for op in ("sum", "min")}
    out |= {name: partial(captured, text) for name, (text, _) in CAPTURE_FILTERS.items()}
    out |= {name: partial(raw_captured, text, whole) for name, (text, _, whole) in RAW_FILTERS.items()}
    out["capture_pushed_filters"] = pushed
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: _rows_sql(where) for name, (_, where) in FILTERS.items()}
    for op in _SQL_OPERATORS:
        for field in AGGREGATE_FIELDS:
            out[f"agg_{op}_{field}"] = _aggregate_sql(op, field, DAY)
    stored = lambda where: _with(f"SELECT {PACKET_SQL} FROM packets WHERE {where}")
    src, dst = _END.format("src_ip", "src_port"), _END.format("dst_ip", "dst_port")
    out |= {
        "agg_interval_1s": _aggregate_sql("sum", "length", 1_000_000),
        "agg_interval_1h": _aggregate_sql("sum", "length", HOUR),
        "agg_interval_1d": _aggregate_sql("sum", "length", DAY),
        "agg_filtered": _aggregate_sql("sum", "length", DAY, FILTERS["filter_and_or_nesting"][1]),
        "console_rows": _with(
            f"SELECT {src} AS src, {dst} AS dst, CAST(proto AS VARCHAR) AS protocol, CAST(length AS VARCHAR) AS length, CAST(ts_us // 1000000 AS VARCHAR) AS sec, CAST(ts_us % 1000000 AS VARCHAR) AS usec FROM packets"
        ),
        "address_text": _with(f"SELECT event_id, {_IP.format('src_ip')} AS src, src_ip, {_IP.format('dst_ip')} AS dst, dst_ip FROM packets"),
        "packet_text": _with(
            f"SELECT event_id, ({src}) || ' -> ' || ({dst}) || ' proto=' || proto || ' length=' || length || ' time=' || (ts_us // 1000000) || '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') AS packet FROM packets"
        ),
        "store_roundtrip": stored("TRUE"),
        "filter_ip_or_proto_store": stored(FILTERS["filter_ip_or_proto"][1]),
        "filter_time_disjoint_store": stored(FILTERS["filter_time_disjoint"][1]),
        "filter_time_range_store": stored(FILTERS["filter_time_range"][1]),
        "store_manifest_host": stored(MANIFEST_HOST[1]),
        "store_disjoint_pruned": stored(FILTERS["filter_time_disjoint"][1]),
        "store_compacted": stored("TRUE"),
        "pcap_roundtrip": stored("TRUE"),
        "pcap_single_file": stored("TRUE"),
        "pcap_single_file_filtered": stored(FILTERS["filter_or_and_nesting"][1]),
        "stream_ingest": stored("TRUE"),
        "store_mixed_ingest": stored("TRUE"),
        "store_uncompressed": stored("TRUE"),
        "capture_statistics": _with("SELECT count(*) AS records, count(*) AS ipv4, CAST(0 AS BIGINT) AS ipv6, count(*) AS kept, CAST(0 AS BIGINT) AS dropped FROM packets"),
        "canonical_names": _with(
            " UNION ALL ".join(
                f"SELECT '{text}' AS filter, '{name}' AS canonical, '{name}_sum_length_3600.000000secs.csv' AS csv, '{name}.pcap' AS pcap, count(*) FILTER ({where}) AS packets FROM packets"
                for text, (name, where) in CANONICAL.items()
            )
        ),
        "agg_fill_gaps": f"WITH {packets_cte()},"
            f" s AS (SELECT (ts_us // {HOUR}) * {HOUR} AS interval, CAST(sum(length) // count(*) AS BIGINT) AS mean_length FROM packets WHERE src_ip = 3232235527 OR dst_ip = 3232235527 GROUP BY 1)"
            f" SELECT g.interval, mean_length FROM (SELECT unnest(range(min(interval), max(interval) + 1, {HOUR})) AS interval FROM s) g LEFT JOIN s USING (interval)",
        "agg_exact_mean": _with(f"SELECT (ts_us // {HOUR}) * {HOUR} AS interval, sum(length)::DOUBLE / count(*) AS mean_length FROM packets WHERE src_ip = 3232235527 OR dst_ip = 3232235527 GROUP BY 1"),
        "flow_rollup": _with(
            "SELECT src_ip, dst_ip, src_port, dst_port, proto, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM packets GROUP BY 1, 2, 3, 4, 5"
        ),
        "host_clusters": _with(
            "SELECT least(src_ip, dst_ip) AS host, count(*) AS packets, count(DISTINCT greatest(src_ip, dst_ip)) AS peers, min(ts_us) AS first_us, max(ts_us) AS last_us FROM packets GROUP BY 1"
        ),
    }
    out |= {
        "flow_sessions": _sessions_sql(),
        "gpv_groups": _groups_sql(),
        "gpv_roundtrip": stored("TRUE"),
        "stream_flow_sessions": _sessions_sql(f"max(ts_us) + {SERVICE_IDLE} <= (SELECT max(ts_us) FROM packets) - {HOUR}"),
        "distinct_bitmap_days": _aggregate_sql("count_dist", "v4Src", DAY),
        "stream_distinct_bitmap": _aggregate_sql("count_dist", "v4Dst", DAY),
    }
    out |= {name: _stream_sql(*how) for name, how in STREAMS.items()}
    out |= {name: _rows_sql(where.format(src=_SWAPPED.format("src_ip"), limit=_SWAPPED.format(167772210))) for name, (_, where) in COMPAT_FILTERS.items()}
    out |= {name: _rows_sql(where) for name, (_, where) in CAPTURE_FILTERS.items()}
    out |= {name: _raw_sql(where, whole) for name, (_, where, whole) in RAW_FILTERS.items()}
    out["capture_pushed_filters"] = stored("proto <> 1 AND length > 60 AND dst_port = 443 AND ts_us >= 1704844800000000")
    swapped = _SWAPPED.format("dst_ip")
    for op, value in (("sum", f"sum({swapped}) % 4294967296"), ("min", f"min({swapped})")):
        out[f"compat_{op}_v4Dst"] = _with(f"SELECT (ts_us // {DAY}) * {DAY} AS interval, CAST({value} AS BIGINT) AS {op}_v4Dst FROM packets GROUP BY 1")
    return out

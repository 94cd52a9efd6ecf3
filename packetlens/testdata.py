"""The ``packets`` view over the ``events`` table: a deterministic packet for each event."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``{us}`` is the event time in epoch microseconds; valid in Spark and DuckDB.
PACKETS_SQL = """SELECT event_id,
  CASE WHEN event_id % 5 = 0 THEN server ELSE client END AS src_ip,
  CASE WHEN event_id % 5 = 0 THEN client ELSE server END AS dst_ip,
  CASE WHEN proto = 1 THEN 0 WHEN event_id % 5 = 0 THEN sport ELSE cport END AS src_port,
  CASE WHEN proto = 1 THEN 0 WHEN event_id % 5 = 0 THEN cport ELSE sport END AS dst_port,
  proto, length, ts_us
FROM (SELECT event_id, 167772161 + user_id AS client, 3232235521 + event_id % 250 AS server, 1024 + event_id % 50000 AS cport,
        CASE WHEN event_id % 3 = 0 THEN 443 WHEN event_id % 3 = 1 THEN 80 ELSE 53 END AS sport,
        CASE WHEN event_type = 'error' THEN 1 WHEN event_id % 3 = 2 THEN 17 ELSE 6 END AS proto,
        40 + CAST(FLOOR(value) AS BIGINT) % 1460 AS length, {us} AS ts_us
      FROM {events}) e"""

SPARK_US, DUCKDB_US = "unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet columns, ``ts`` and, beside them, ``event_id`` and ``ts_us``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.sql(PACKETS_SQL.format(us=SPARK_US, events="{events}"), events=events)
    return rows.withColumn("ts", F.timestamp_micros("ts_us"))


#: What a packet's frame has beside the packet's columns; valid in Spark and DuckDB.
FRAME_FIELDS = "event_id % 7 = 0 AS v6, CASE WHEN event_id % 3 = 0 THEN 100 + event_id % 4 ELSE -1 END AS vid, event_id * 7 % 64 AS flags, 32 + event_id % 64 AS ttl"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Ethernet frame for each packet: some tagged, some IPv6, TCP with flags; columns ts, length (100 more than the packet's) and frame."""
    rows = packets(spark, sf_dir).selectExpr("*", *[x.strip() for x in FRAME_FIELDS.split(", ")])

    def number(value: Column | int, size: int) -> Column:
        return F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("long")), 2 * size, "0")

    col = F.col
    tag = F.when(col("vid") >= 0, F.concat(F.lit("8100"), number(col("vid"), 2))).otherwise("")
    proto = F.when(col("v6") & (col("proto") == 1), 58).otherwise(col("proto"))
    tcp = F.concat(number(col("src_port"), 2), number(col("dst_port"), 2), number(col("event_id"), 4), number(0, 4), F.lit("50"), number(col("flags"), 1), number(0, 6))
    udp = F.concat(number(col("src_port"), 2), number(col("dst_port"), 2), number(8, 2), number(0, 2))
    icmp = F.concat(number(F.when(col("v6"), 128).otherwise(8), 1), number(0, 7))
    body = F.when(col("proto") == 6, tcp).when(col("proto") == 17, udp).otherwise(icmp)
    size = F.length(body) / 2
    four = F.concat(F.lit("08004500"), number(20 + size, 2), number(0, 4), number(col("ttl"), 1), number(proto, 1), number(0, 2), number(col("src_ip"), 4), number(col("dst_ip"), 4))
    six = F.concat(F.lit("86DD60000000"), number(size, 2), number(proto, 1), number(col("ttl"), 1), F.lit("20010DB8"), number(0, 8), number(col("src_ip"), 4), F.lit("20010DB8"), number(0, 8), number(col("dst_ip"), 4))
    frame = F.unhex(F.concat(F.lit("0200000000020200" + "00000001"), tag, F.when(col("v6"), six).otherwise(four), body))
    return rows.select("ts", (col("length") + 100).cast("int").alias("length"), frame.alias("frame"))


def packets_cte() -> str:
    return f"packets AS ({PACKETS_SQL.format(us=DUCKDB_US, events='events')})"

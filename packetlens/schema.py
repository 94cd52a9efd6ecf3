"""The packet table: one fixed schema, and the names its columns have in filters and aggregates."""

from pyspark.sql.types import IntegerType, LongType, ShortType, StructField, StructType, TimestampType

#: Addresses are network-order numbers 0 .. 2**32 - 1; ports are 0 for ICMP; length is the original frame length.
PACKET_SCHEMA = StructType(
    [
        StructField("src_ip", LongType()),
        StructField("dst_ip", LongType()),
        StructField("src_port", IntegerType()),
        StructField("dst_port", IntegerType()),
        StructField("proto", ShortType()),
        StructField("length", IntegerType()),
        StructField("ts", TimestampType()),
    ]
)
PACKET_COLUMNS = PACKET_SCHEMA.fieldNames()

ICMP, TCP, UDP = 1, 6, 17
PROTOCOLS = {"icmp": ICMP, "tcp": TCP, "udp": UDP}

#: Aggregate field -> column.
AGGREGATE_FIELDS = {"v4Src": "src_ip", "v4Dst": "dst_ip", "portSrc": "src_port", "portDst": "dst_port", "protocol": "proto", "length": "length"}
ADDRESS_FIELDS = {"v4Src", "v4Dst"}

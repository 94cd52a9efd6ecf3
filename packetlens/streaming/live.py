"""Live ingest and live aggregates over a folder of rotated captures (or any stream of packets).

A network card is outside Spark: a capture tool rotates files into a folder, and the stream follows it.
Ingest appends clustered micro-batches to the store; a batch that is retried after a lost driver overwrites its
own folder, so no packet is stored twice. Aggregates are tumbling or sliding windows with a watermark: late packets up to it
are counted, later ones are dropped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetlens.operators.engine import SECOND, aggregate_column
from packetlens.operators.flows import FIVE_TUPLE, IDLE, flow_sessions
from packetlens.plans.store import write_store
from packetlens.schema import AGGREGATE_FIELDS
from packetlens.sources.pcap import register

FLUSH = "10 seconds"


def stream_packets(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("pcap").load(folder)


def stream_ingest(packets: DataFrame, store: str, checkpoint: str, trigger: dict | None = None, partitions: int | None = None) -> StreamingQuery:
    """Append a stream of packets to a store, which may have batches of other streams and of files.

    A micro-batch is a batch of the store, named by the stream's checkpoint folder and its number.
    """
    stream = hashlib.blake2b(checkpoint.rstrip("/").encode(), digest_size=8).hexdigest()

    def write(df: DataFrame, batch_id: int) -> None:
        write_store(df, store, batch=f"{stream}-{batch_id}", partitions=partitions)

    return packets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": FLUSH})).start()


def stream_aggregate(
    packets: DataFrame, op: str = "sum", field: str = "length", interval: int = SECOND, watermark: str = "10 minutes", slide: int | None = None, approximate: bool = False
) -> DataFrame:
    """interval, <op>_<field> of a stream, in tumbling windows or, with ``slide`` (microseconds), in sliding ones.

    Distinct counts are exact and keep a window's distinct values in its state; ``approximate`` keeps a sketch.
    """
    window = F.window("ts", f"{interval} microseconds", f"{slide or interval} microseconds")
    kept = packets.withWatermark("ts", watermark).groupBy(window.alias("w"))
    if op == "count_dist" and not approximate:
        value = F.size(F.collect_set(F.col(AGGREGATE_FIELDS[field]))).cast("long").alias(f"{op}_{field}")
    else:
        value = aggregate_column(op, field, approximate=approximate)
    return kept.agg(value).select(F.unix_micros("w.start").alias("interval"), f"{op}_{field}")


def stream_sessions(packets: DataFrame, keys: list[str] = FIVE_TUPLE, idle_us: int = IDLE, watermark: str = "10 minutes") -> DataFrame:
    """Finished sessions of the flows of a stream, for append mode: each once, when the watermark has passed its idle time; later packets of it are dropped."""
    return flow_sessions(packets.withWatermark("ts", watermark), keys, idle_us)


def stream_bitmaps(packets: DataFrame, field: str, interval: int, watermark: str = "10 minutes") -> DataFrame:
    """interval, bucket, bitmap of the distinct addresses of a stream: state of at most 4 KB for each 32768 addresses and slot, exact; count with ``flows.bitmap_counts``."""
    value = F.col(AGGREGATE_FIELDS[field]).cast("long")
    window = F.window("ts", f"{interval} microseconds").alias("w")
    kept = packets.withWatermark("ts", watermark).groupBy(window, F.bitmap_bucket_number(value).alias("bucket"))
    return kept.agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bitmap")).select(F.unix_micros("w.start").alias("interval"), "bucket", "bitmap")

"""The packet store: Parquet in batches, partitioned by UTC date, clustered by host and time.

Every ingest, of files or of a live batch, is one folder ``batch=<name>/ts_date=<date>``. Clustering makes both ends of a
conversation compress well and gives row groups tight address and time ranges;
bloom filters answer address equality inside them. Reading takes the files that the manifest leaves (see ``manifest``), adds the dates that a filter implies as an
explicit partition predicate and leaves the rest to Catalyst and Parquet.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from packetlens.operators.engine import PacketFrame
from packetlens.operators.flows import host_key
from packetlens.plans import dsl
from packetlens.plans.manifest import COMPACTED, Folder, batch_sizes, forget_manifest, small_bins, store_files, write_manifest
from packetlens.plans.session import checkpoint_folder
from packetlens.schema import PACKET_COLUMNS, PACKET_SCHEMA

PARTITION, BATCH = "ts_date", "batch"
ROWS_PER_FILE = 50_000_000
#: Hosts of a date are dealt to so many groups; Spark joins small groups and splits large ones.
HOST_GROUPS = 16


def write_store(
    df: DataFrame, path: str, batch: str | None = None, partitions: int | None = None, compression: str = "zstd", observation: Observation | None = None, replaces: list[str] | None = None
) -> None:
    """Write packets and the manifest of one batch of the store; a batch written again replaces itself, a new name appends.

    One shuffle on (date, host group), without a pass that samples, so a source is read once. Adaptive execution
    splits a busy day or host by its rows and joins small groups. ``compression`` may be "uncompressed";
    ``observation`` gets the rows and bytes written.
    """
    utc_date = F.date_from_unix_date(F.expr("CAST(floor(unix_micros(ts) / 86400000000) AS INT)"))
    keyed = df.withColumn(PARTITION, utc_date).withColumn("host_key", host_key()).withColumn("host_group", F.pmod(F.xxhash64("host_key"), F.lit(HOST_GROUPS)))
    dealt = keyed.repartition(partitions, PARTITION, "host_group") if partitions else keyed.hint("rebalance", PARTITION, "host_group")
    if observation is not None:
        dealt = dealt.observe(observation, F.count(F.lit(1)).alias("rows"), F.sum(F.col("length").cast("long")).alias("bytes"))
    writer = dealt.sortWithinPartitions(PARTITION, "host_key", "ts").drop("host_key", "host_group").write.mode("overwrite").partitionBy(PARTITION)
    for key, value in (store_options() | {"compression": compression}).items():
        writer = writer.option(key, value)
    batch = batch or uuid.uuid4().hex
    forget_manifest(df.sparkSession, path, batch)
    writer.parquet(f"{path.rstrip('/')}/{BATCH}={batch}")
    if store_has_batch(df.sparkSession, path, batch):
        write_manifest(df.sparkSession, path, batch, replaces)


def store_options() -> dict[str, str]:
    return {
        "parquet.writer.version": "v2",
        "parquet.bloom.filter.enabled#src_ip": "true",
        "parquet.bloom.filter.enabled#dst_ip": "true",
        "parquet.bloom.filter.expected.ndv#src_ip": "100000",
        "parquet.bloom.filter.expected.ndv#dst_ip": "100000",
        "maxRecordsPerFile": str(ROWS_PER_FILE),
    }


def store_has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a written batch has packets: one of none has no date."""
    return any(name.startswith(PARTITION) for name, _ in Folder(spark, path).names(f"{BATCH}={batch}"))


#: The columns of a store without files to read; the last two are folders.
STORED = StructType([*PACKET_SCHEMA.fields, StructField(BATCH, StringType()), StructField(PARTITION, DateType())])


def read_store(spark: SparkSession, path: str, filter_text: str = "", compat: bool = False, ignore_corrupt: bool = False) -> PacketFrame:
    """Packets of a store that pass a filter; without the partition columns. Which files are read is settled here."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    tree = dsl.parse(filter_text, zone)
    files = store_files(spark, path, tree)
    reader = spark.read.option("ignoreCorruptFiles", str(ignore_corrupt).lower()).option("basePath", path)
    df = reader.parquet(*files) if files else spark.createDataFrame([], STORED)
    dates = dsl.date_predicate(tree, PARTITION)
    if dates is not None:
        df = df.where(dates)
    return PacketFrame(df.select(*PACKET_COLUMNS), compat=compat).filter(filter_text)


def unreadable(frame: PacketFrame) -> str | None:
    """A file of those that a query reads whose footer Spark cannot read, or what it says; None if all are fine. Reads footers only."""
    files = frame.df.inputFiles()
    if not files:
        return None
    try:
        frame.df.sparkSession.read.option("ignoreCorruptFiles", "false").parquet(*files).count()
    except Exception as e:  # noqa: BLE001  (whatever the reader raises is what is to be reported)
        found = re.search(r"\S*/part-[^\s\]]+", str(e))
        return found[0] if found else str(e).strip().splitlines()[0]
    return None


#: Bytes of a compacted batch.
COMPACT_BYTES = 1 << 30


def compact_store(spark: SparkSession, path: str, target_bytes: int = COMPACT_BYTES, partitions: int | None = None) -> int:
    """Rewrite small batches, as live ingest leaves them, as few of about ``target_bytes``; returns how many batches were replaced.

    Readers see the old batches or the new one, never both or neither; ``manifest.vacuum`` removes what is hidden. One compaction runs at a time.
    """
    replaced = 0
    for names in small_bins(batch_sizes(spark, path), target_bytes):
        df = spark.read.option("basePath", path).parquet(*[f"{path.rstrip('/')}/{BATCH}={n}" for n in names]).select(*PACKET_COLUMNS)
        write_store(df, path, batch=COMPACTED + uuid.uuid4().hex, partitions=partitions, replaces=names)
        replaced += len(names)
    return replaced


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

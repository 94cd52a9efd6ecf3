"""The store's manifest: what is in each file, so that a query opens only files that can have its packets.

Beside its batches a store has a folder ``_manifest`` with a small table for each batch: a row a file with its packets, first and last time, and a
sketch of its hosts. The sketch is a bitmap of hashed addresses in BUCKETS parts of 4 KB, built by partial aggregates. A filter's
time intervals and the addresses that it asks for are tested against these rows by Spark, before any file is listed or opened; what the
driver gets is the list of files to read, which it needs for any scan.

A committed batch is visible without a manifest (an older store, a writer that died before it); then it is read whole. A table is written aside
and renamed, so it is there or not. That makes compaction atomic: the manifest of a compacted batch names the batches that it replaces, and
from its rename on readers see the new batch instead of those. Replaced batches stay until ``vacuum``, for readers that began before.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.plans import dsl

MANIFEST, ASIDE, COMPACTED = "_manifest", "_aside", "compact-"
#: Parts of a host sketch; one has 32768 bits.
BUCKETS, BITS = 16, 32_768
#: A filter that asks for more addresses is not tested against the sketches.
MOST_HOSTS = 256
FILE = "batch string, file string, replaces array<string>, packets long, bytes long, low long, high long, hosts map<int, binary>"


class Folder:
    """A store's folder in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str):
        return self.hadoop.Path("/".join((self.path, *names)))

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self.at(*names))

    def names(self, *folder: str) -> list[tuple[str, int]]:
        """Names and modification times (ms) in a folder; none if there is no such folder."""
        if not self.exists(*folder):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(self.at(*folder)))

    def delete(self, *names: str) -> None:
        self.fs.delete(self.at(*names), True)

    def rename(self, old: tuple[str, ...], new: tuple[str, ...]) -> None:
        self.fs.mkdirs(self.at(*new[:-1]))
        if not self.fs.rename(self.at(*old), self.at(*new)):
            raise OSError(f"cannot rename {'/'.join(old)} to {'/'.join(new)} in {self.path}")


def host_bit(host: Column) -> Column:
    """Where an address is in a sketch."""
    return F.pmod(F.xxhash64(host.cast("long")), F.lit(BUCKETS * BITS))


def file_rows(packets: DataFrame, batch: str, replaces: list[str]) -> DataFrame:
    """The manifest of a written batch, from its packets."""
    path, size = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
    us = F.unix_micros("ts")
    about = packets.groupBy(path, size).agg(F.count(F.lit(1)).alias("packets"), F.min(us).alias("low"), F.max(us).alias("high")).withColumn("key", F.xxhash64("path"))
    # distinct bits first, by partial aggregates on numbers: what moves is at most BUCKETS * BITS rows a file, and only those are made bitmaps
    bits = packets.select(F.xxhash64("_metadata.file_path").alias("key"), F.explode(F.array(host_bit(F.col("src_ip")), host_bit(F.col("dst_ip")))).alias("bit")).distinct()
    maps = bits.groupBy("key", F.expr(f"cast(bit div {BITS} AS int)").alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % BITS).alias("bitmap"))
    hosts = maps.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bitmap"))).alias("hosts"))
    replaced = F.lit(replaces).cast("array<string>") if replaces else F.array().cast("array<string>")
    file = F.substring_index("path", "/", -3).alias("file")
    return about.join(hosts, "key").select(F.lit(batch).alias("batch"), file, replaced.alias("replaces"), "packets", "bytes", "low", "high", "hosts")


def write_manifest(spark: SparkSession, store: str, batch: str, replaces: list[str] | None = None) -> None:
    """Describe a batch that is wholly written; with ``replaces``, hide those batches in the same moment."""
    folder, aside = Folder(spark, store), uuid.uuid4().hex
    rows = file_rows(spark.read.parquet(f"{folder.path}/batch={batch}"), batch, replaces or [])
    rows.write.parquet(f"{folder.path}/{ASIDE}/{aside}")
    folder.delete(MANIFEST, batch)
    folder.rename((ASIDE, aside), (MANIFEST, batch))


def forget_manifest(spark: SparkSession, store: str, batch: str) -> None:
    """A batch that is about to be written again has no manifest meanwhile."""
    folder = Folder(spark, store)
    if folder.exists(MANIFEST, batch):
        folder.delete(MANIFEST, batch)


def manifest(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows of all files that have a manifest; None if the store has none."""
    folder = Folder(spark, store)
    names = [name for name, _ in folder.names(MANIFEST)]
    return spark.read.schema(FILE).parquet(*[f"{folder.path}/{MANIFEST}/{name}" for name in names]) if names else None


def visible_batches(spark: SparkSession, store: str) -> tuple[list[str], set[str], DataFrame | None]:
    """The batches that readers see, those of them that have a manifest, and the rows of these."""
    folder = Folder(spark, store)
    # the manifest first: a batch that is replaced between the two listings is still there, one that replaces is not in them
    rows = manifest(spark, store)
    described: set[str] = set()
    replaced: set[str] = set()
    if rows is not None:
        for r in rows.select("batch", "replaces").distinct().collect():
            described.add(r["batch"])
            replaced |= set(r["replaces"])
    batches = [name.partition("=")[2] for name, _ in folder.names() if name.startswith("batch=")]
    # without a manifest a batch must at least be committed: one that is being written is not seen
    whole = lambda b: b in described or (not b.startswith(COMPACTED) and folder.exists(f"batch={b}", "_SUCCESS"))
    seen = [b for b in batches if b not in replaced and whole(b)]
    return seen, described & set(seen), rows


def may_match(tree: dsl.Node) -> Column | None:
    """A predicate on manifest rows that no file with matching packets fails; None if the filter says nothing of times and hosts."""
    tests = []
    times = dsl.time_intervals(tree)
    if not times:
        return F.lit(False)
    if times != dsl.ALWAYS:
        overlaps = [(F.col("high") >= low) & (F.col("low") <= high) for low, high in dsl.fewer(times)]
        tests.append(dsl.balanced(overlaps, dsl.Or))
    for hosts in dsl.host_sets(tree):
        if len(hosts) <= MOST_HOSTS:
            tests.append(dsl.balanced([_has(host) for host in sorted(hosts)], dsl.Or))
    return dsl.balanced(tests, dsl.And) if tests else None


def _has(host: int) -> Column:
    bit = host_bit(F.lit(host))
    bitmap = F.element_at("hosts", F.call_function("div", bit, F.lit(BITS)).cast("int"))
    byte = F.conv(F.hex(F.substring(bitmap, F.call_function("div", bit % BITS, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def store_files(spark: SparkSession, store: str, tree: dsl.Node) -> list[str]:
    """What a query has to read: files by the manifest, whole batches where there is none."""
    path = store.rstrip("/")
    batches, described, rows = visible_batches(spark, store)
    test = may_match(tree)
    if rows is None or test is None or not described:
        return [f"{path}/batch={b}" for b in batches]
    files = rows.where(F.col("batch").isin(sorted(described))).where(test) if len(described) < len(batches) or len(described) < 1000 else rows.where(test)
    kept = [r["file"] for r in files.select("batch", "file").collect() if r["batch"] in described]
    return [f"{path}/{f}" for f in sorted(kept)] + [f"{path}/batch={b}" for b in batches if b not in described]


def small_bins(sizes: list[tuple[str, int, int]], target: int) -> list[list[str]]:
    """Batches (name, first time, bytes) smaller than ``target`` in bins of about that size, neighbours in time together."""
    bins: list[list[str]] = []
    room = 0
    for name, _, size in sorted((s for s in sizes if s[2] < target), key=lambda s: (s[1], s[0])):
        if not bins or size > room:
            bins.append([])
            room = target
        bins[-1].append(name)
        room -= size
    return [b for b in bins if len(b) > 1]


def batch_sizes(spark: SparkSession, store: str) -> list[tuple[str, int, int]]:
    """Name, first time and bytes of each visible batch that has a manifest."""
    _, described, rows = visible_batches(spark, store)
    if rows is None:
        return []
    found = rows.groupBy("batch").agg(F.min("low").alias("low"), F.sum("bytes").alias("bytes")).collect()
    return [(r["batch"], r["low"], r["bytes"]) for r in found if r["batch"] in described]


def vacuum(spark: SparkSession, store: str, older_than_seconds: float = 3600) -> int:
    """Remove batches that were replaced so long ago, and unfinished compactions of that age; returns how many."""
    folder, limit = Folder(spark, store), (time.time() - older_than_seconds) * 1000
    seen, _, rows = visible_batches(spark, store)
    replaced_at: dict[str, int] = {}
    if rows is not None:
        written = dict(folder.names(MANIFEST))
        for r in rows.select("batch", F.explode("replaces").alias("old")).distinct().collect():
            replaced_at[r["old"]] = max(replaced_at.get(r["old"], 0), written.get(r["batch"], 0))
    gone = 0
    for name, changed in folder.names():
        batch = name.partition("=")[2]
        if name.startswith("batch=") and batch not in seen and replaced_at.get(batch, changed) <= limit:
            # first the data: without its manifest a replaced batch stays hidden, since that of its successor names it
            folder.delete(name)
            folder.delete(MANIFEST, batch)
            gone += 1
    for name, changed in folder.names(ASIDE):
        if changed <= limit:
            folder.delete(ASIDE, name)
    return gone

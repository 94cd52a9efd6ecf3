"""Capture files as Spark tables: batch and streaming data source ``pcap``, and a reader for any store.

``spark.read.format("pcap").load(path)`` reads a folder, glob or file on a file system whose byte ranges tasks can read; captures beyond
``splitbytes`` (0: never) are read in parts, whose ends are checked against each other. A pcapng part also has to know the interfaces before it: ``open_captures`` has the
parts looked through for them by a first, small job; without that (option ``tables``) pcapng is read a file a task. ``read_pcap`` goes through Spark's own
``binaryFile`` reader instead and so reaches every store Spark does, a file a task. ``open_captures`` takes the first where it can.

Option ``capturefilter`` is a filter in pcap-filter syntax that is tested on the raw frames before rows are made; comparisons of columns
are pushed down too. Option ``frames`` ("true") returns the frames themselves, of any protocol: ts, length, link, frame. Option ``counts`` ("true") adds a row for each
file or part with what was seen there (``COUNTS``), packet columns null, so one read gives packets and counts.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, WriterCommitMessage
)
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType, TimestampType

from packetlens.plans.session import ship
from packetlens.schema import PACKET_SCHEMA
from packetlens.sources.capture import (
    FILE_HEADER, OVERLAP, PCAPNG, CaptureError, Load, Packets, RawFrames, Tables, _decoded, _raw, can_split, capture_pieces, classic_part, file_header, frame_records, loaded, packet_records, pcapng_part, pcapng_split
)
from packetlens.sources.packet_filter import compile_packet_filter
from packetlens.sources.ranges import file_size, files_at, is_remote, local_path, opened, reachable, read_range

SUFFIXES = (".pcap", ".pcapng", ".cap")
BATCH = 1 << 20
SPLIT_BYTES = 64 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

ARROW_SCHEMA = pa.schema(
    [("src_ip", pa.int64()), ("dst_ip", pa.int64()), ("src_port", pa.int32()), ("dst_port", pa.int32()), ("proto", pa.int16()), ("length", pa.int32()), ("ts", pa.timestamp("us", tz="UTC"))]
)


FRAME_SCHEMA = StructType([StructField("ts", TimestampType()), StructField("length", IntegerType()), StructField("link", IntegerType()), StructField("frame", BinaryType())])
ARROW_FRAMES = pa.schema([("ts", pa.timestamp("us", tz="UTC")), ("length", pa.int32()), ("link", pa.int32()), ("frame", pa.binary())])


def to_arrow(p: Packets | RawFrames) -> Iterator[pa.RecordBatch]:
    if isinstance(p, RawFrames):
        for start in range(0, max(1, len(p.data)), BATCH_FRAMES):
            some = slice(start, start + BATCH_FRAMES)
            columns = [pa.array(p.ts_us[some], pa.int64()).cast(ARROW_FRAMES.field("ts").type), pa.array(p.length[some]).cast(pa.int32()), pa.array(p.link[some]).cast(pa.int32()), pa.array(p.data[some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW_FRAMES)
        return
    columns = [p.src_ip, p.dst_ip, p.src_port, p.dst_port, p.proto, p.length]
    arrays = [pa.array(c).cast(f.type) for c, f in zip(columns, ARROW_SCHEMA, strict=False)] + [pa.array(p.ts_us, pa.int64()).cast(ARROW_SCHEMA.field("ts").type)]
    table = pa.RecordBatch.from_arrays(arrays, schema=ARROW_SCHEMA)
    for start in range(0, max(1, len(p)), BATCH):
        yield table.slice(start, BATCH)


BATCH_FRAMES = 1 << 14
#: What is counted of a file or part: records, by kind, and files that are no captures.
COUNTS = ["records", "ipv4", "ipv6", "kept", "dropped", "unreadable"]
COUNTED_SCHEMA = StructType([*PACKET_SCHEMA.fields, *[StructField(c, LongType()) for c in COUNTS]])


def count_row(seen: dict[str, int]) -> pa.RecordBatch:
    columns = [pa.nulls(1, f.type) for f in ARROW_SCHEMA] + [pa.array([seen.get(c, 0)], pa.int64()) for c in COUNTS]
    return pa.RecordBatch.from_arrays(columns, [*ARROW_SCHEMA.names, *COUNTS])


def with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets with null counts."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.nulls(batch.num_rows, pa.int64())] * len(COUNTS)], [*ARROW_SCHEMA.names, *COUNTS])


def capture_files(path: str) -> list[str]:
    """The capture files of a folder, glob or single path, in name order."""
    return files_at(path, SUFFIXES)


class FilePartition(InputPartition):
    """A capture file, or the records of one that begin in bytes [start, stop); for pcapng with the tables before them."""

    def __init__(self, path: str, start: int = 0, stop: int = 0, tables: Tables | None = None):
        self.path, self.start, self.stop, self.tables = path, start, stop, tables


def splits(path: str, split_bytes: int, found: list | None = None) -> list[FilePartition]:
    """A large capture in parts of about ``split_bytes``; pcapng only with its tables (``found``), any other file whole."""
    size = file_size(path)
    n = size // split_bytes if split_bytes else 1
    if n < 2:
        return [FilePartition(path)]
    head = read_range(path, 0, 24)
    if can_split(head):
        ends = [24 + (size - 24) * i // n for i in range(n)] + [size]
        return [FilePartition(path, a, b) for a, b in zip(ends, ends[1:], strict=False)]
    if head[:4] != PCAPNG or found is None:
        return [FilePartition(path)]
    out, todo, tables = [], sorted(found), Tables()
    for start, stop in block_parts(size, n):
        while todo and todo[0][0] < start:
            _, kind, a, b = todo.pop(0)
            if kind == "section":
                tables = Tables(order="<" if a else ">")
            else:
                tables = Tables(tables.order, [*tables.links, a], [*tables.units, b])
        out.append(FilePartition(path, start, stop, tables))
    return out


def block_parts(size: int, n: int) -> list[tuple[int, int]]:
    """A pcapng file's bytes in n parts that begin at multiples of four, as blocks do."""
    ends = [size * i // n // 4 * 4 for i in range(n)] + [size]
    return list(zip(ends, ends[1:], strict=False))


def part_pieces(load: Load, size: int, partition: FilePartition) -> Iterator[tuple]:
    """The records of a file or part, piece by piece; a whole file that is no capture is an error at once."""
    if not partition.stop:
        return capture_pieces(load, size)
    if partition.tables is None:
        return classic_part(load, size, partition.start, partition.stop)
    return pcapng_part(load, size, partition.start, partition.stop, Tables(partition.tables.order, list(partition.tables.links), list(partition.tables.units)))


class Reading:
    """What a reader does with records: options ``capturefilter`` and ``frames``, and pushed filters."""

    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("ignorecorrupt", "false").lower() != "true"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.filter, self.frames = options.get("capturefilter", ""), options.get("frames", "false").lower() == "true"
        self.tables, self.counts = json.loads(options.get("tables", "{}")), options.get("counts", "false").lower() == "true"
        self.pushed: list[Filter] = []
        compile_packet_filter(self.filter)  # a syntax error is raised before any task runs

    def parts(self, files: list[str]) -> list[FilePartition]:
        return [p for f in files for p in splits(f, self.split_bytes, self.tables.get(f))]

    def rows(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        keep = compile_packet_filter(self.filter) if self.filter else None
        make, seen = _raw if self.frames else _decoded, Counter()
        with opened(partition.path) as (load, size):
            try:
                pieces = part_pieces(load, size, partition)
            except CaptureError:
                if self.strict:
                    raise
                print(f"not critical: {partition.path} is no readable capture, skipped")
                pieces, seen = [], Counter(unreadable=1)
            # parts that do not meet are an error that is never skipped: that would lose records
            for piece in pieces:
                found = make(*piece, keep)
                rows = self.passed(to_arrow(found))
                if self.counts:
                    seen.update(found.seen)
                    rows = with_counts(rows)
                yield from rows
        if self.counts:
            yield count_row(seen)

    def passed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if self.pushed:
                mask = np.ones(batch.num_rows, bool)
                for f in self.pushed:
                    mask &= filter_mask(f, batch)
                batch = batch.filter(pa.array(mask))
            yield batch


_COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def can_push(f: Filter) -> bool:
    """Whether the source tests a filter itself: comparisons of numbers and times."""
    if isinstance(f, Not):
        return can_push(f.child)
    if isinstance(f, IsNotNull):
        return True
    values = f.value if isinstance(f, In) else [f.value] if type(f) in _COMPARE else [None]
    return len(f.attribute) == 1 and all(isinstance(v, (int, datetime)) and not isinstance(v, bool) for v in values)


def _number(value: int | datetime) -> int:
    if not isinstance(value, datetime):
        return value
    moment = value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc)
    since = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


def filter_mask(f: Filter, batch: pa.RecordBatch) -> np.ndarray:
    """The rows of a batch, which has no nulls, that pass a pushed filter."""
    if isinstance(f, Not):
        return ~filter_mask(f.child, batch)
    if isinstance(f, IsNotNull):
        return np.ones(batch.num_rows, bool)
    column = batch.column(batch.schema.get_field_index(f.attribute[0]))
    values = (column.cast(pa.int64()) if pa.types.is_timestamp(column.type) else column).to_numpy(zero_copy_only=False).astype(np.int64)
    if isinstance(f, In):
        return np.isin(values, [_number(v) for v in f.value])
    return _COMPARE[type(f)](values, _number(f.value))


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.reading = Reading(options)

    def pushFilters(self, filters):
        for f in filters:
            if can_push(f) and not self.reading.counts:
                self.reading.pushed.append(f)
            else:
                yield f

    def partitions(self):
        files = capture_files(self.reading.path)
        if not files:
            raise FileNotFoundError(f"no capture file at {self.reading.path}")
        return self.reading.parts(files)

    def read(self, partition):
        yield from self.reading.rows(partition)


class PcapStreamReader(DataSourceStreamReader):
    """New files of a folder of rotated captures, whatever their names; the offset is the folder's list of names.

    Writers must move finished files in. A file that was removed and comes back is read again.
    """

    def __init__(self, options: dict):
        self.reading = Reading(options)
        self.path = self.reading.path

    def initialOffset(self):
        return {"names": []}

    def latestOffset(self):
        return {"names": [os.path.basename(f) for f in capture_files(self.path)]}

    def partitions(self, start, end):
        new = set(end["names"]) - set(start["names"])
        return self.reading.parts([f for f in capture_files(self.path) if os.path.basename(f) in new])

    def read(self, partition):
        yield from self.reading.rows(partition)


class PartMessage(WriterCommitMessage):
    def __init__(self, path: str, final: str, rows: int):
        self.path, self.final, self.rows = path, final, rows


class PcapWriter(DataSourceArrowWriter):
    """A capture for each task, under a temporary name until the job commits: of packets, or of whole frames with ts and length (option ``link``, Ethernet if not said)."""

    def __init__(self, options: dict, overwrite: bool, frames: bool = False):
        self.path, self.overwrite, self.frames, self.link = local_path(options["path"]), overwrite, frames, int(options.get("link", 1))

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.pcap"
        temporary, rows = os.path.join(self.path, "." + name), 0
        with open(temporary, "wb") as f:
            f.write(file_header(self.link) if self.frames else FILE_HEADER)
            for batch in iterator:
                f.write(frame_batch_records(batch) if self.frames else batch_records(batch))
                rows += batch.num_rows
        return PartMessage(temporary, os.path.join(self.path, name), rows)

    def commit(self, messages):
        kept = {m.final for m in messages if m}
        if self.overwrite:
            for old in capture_files(self.path):
                if old not in kept:
                    os.remove(old)
        for m in messages:
            if m:
                os.replace(m.path, m.final)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


def batch_records(batch: pa.RecordBatch) -> bytes:
    get = lambda n: batch.column(batch.schema.get_field_index(n))
    us = get("ts").cast(pa.int64()).to_numpy(zero_copy_only=False)
    return packet_records(*[get(n).to_numpy(zero_copy_only=False) for n in ("src_ip", "dst_ip", "src_port", "dst_port", "proto", "length")], us)


def frame_batch_records(batch: pa.RecordBatch) -> bytes:
    get = lambda n: batch.column(batch.schema.get_field_index(n))
    return frame_records(get("ts").cast(pa.int64()).to_pylist(), get("length").to_pylist(), get("frame").to_pylist())


class PcapDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        asked = {name for name in ("frames", "counts") if self.options.get(name, "false").lower() == "true"}
        if len(asked) > 1:
            raise ValueError("options frames and counts exclude each other")
        return FRAME_SCHEMA if "frames" in asked else COUNTED_SCHEMA if asked else PACKET_SCHEMA

    def reader(self, schema: StructType):
        return PcapReader(self.options)

    def streamReader(self, schema: StructType):
        return PcapStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return PcapWriter(self.options, overwrite, "frame" in schema.names)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(PcapDataSource)


def pcapng_tables(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, files: list[str] | None = None) -> dict[str, list]:
    """The sections and interfaces of large pcapng files at ``path``, or of ``files``: (offset, kind, byte order or link type, time unit) by file.

    One job looks through all parts side by side; what comes back are a few rows a file.
    """
    parts = []
    for file in capture_files(path) if files is None else files:
        size = file_size(file)
        if split_bytes and size >= 2 * split_bytes and read_range(file, 0, 4) == PCAPNG:
            parts += [(file, a, b, size) for a, b in block_parts(size, size // split_bytes)]
    if not parts:
        return {}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop, size, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, found = read_range(file, start, stop - start + 2 * OVERLAP), []
                pcapng_split(data, start == 0, stop - start, start + len(data) >= size, found=found)
                if found:
                    at, kind, a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict({"file": [file] * len(at), "at": [start + x for x in at], "kind": list(kind), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    table = spark.createDataFrame([(*p, i) for i, p in enumerate(parts)], "file string, start long, stop long, size long, part int").repartitionById(len(parts), F.col("part"))
    out: dict[str, list] = {file: [] for file, *_ in parts}
    for r in table.mapInArrow(look, "file string, at long, kind string, a long, b long").collect():
        out[r["file"]].append([r["at"], r["kind"], r["a"], r["b"]])
    return {file: sorted(found) for file, found in out.items()}


def open_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, capture_filter: str = "", frames: bool = False) -> DataFrame:
    """Packets (or frames) of the captures at ``path``, in parts of large files where the path allows it."""
    if is_remote(path) and not reachable(path):
        return read_pcap(spark, path, capture_filter, frames)
    register(spark)
    how = {"splitbytes": split_bytes, "capturefilter": capture_filter, "frames": str(frames).lower(), "tables": json.dumps(pcapng_tables(spark, path, split_bytes))}
    return spark.read.format("pcap").options(**how).load(path)


def counted_captures(spark: SparkSession, path: str, observation: Observation, strict: bool = True) -> DataFrame:
    """Packets of the captures at ``path``; when they have been read once, ``observation`` has the sums of ``COUNTS``."""
    if is_remote(path) and not reachable(path):
        raise ValueError(f"no ranges can be read at {path}; use capture_statistics")
    register(spark)
    how = {"counts": "true", "ignorecorrupt": str(not strict).lower(), "tables": json.dumps(pcapng_tables(spark, path))}
    read = spark.read.format("pcap").options(**how).load(path)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    return read.observe(observation, *sums).where(F.col(COUNTS[0]).isNull()).drop(*COUNTS)


def read_pcap(spark: SparkSession, path: str, capture_filter: str = "", frames: bool = False) -> DataFrame:
    """Packets (or frames) of the captures at ``path`` in any store that Spark reads, a file a task."""
    ship(spark)
    compile_packet_filter(capture_filter)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = compile_packet_filter(capture_filter) if capture_filter else None
        for batch in batches:
            for content in batch.column(0):
                for piece in capture_pieces(*loaded(memoryview(content.as_buffer()))):
                    yield from to_arrow((_raw if frames else _decoded)(*piece, keep))

    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return content.mapInArrow(parse, FRAME_SCHEMA if frames else PACKET_SCHEMA)


def capture_statistics(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, records, ipv4, ipv6, kept, dropped of each capture file, by parts of large files; where no ranges can be read, a file a task."""
    ship(spark)
    names = ["records", "ipv4", "ipv6", "kept", "dropped"]
    counted = "path string, " + ", ".join(f"{n} long" for n in names)

    def row(at: str, pieces: Iterator[tuple]) -> pa.RecordBatch:
        seen = Counter()
        for piece in pieces:
            seen.update(_decoded(*piece).seen)
        return pa.RecordBatch.from_pydict({"path": [at], **{n: [seen[n]] for n in names}})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0), batch.column(1), strict=True):
                yield row(at.as_py(), capture_pieces(*loaded(memoryview(content.as_buffer()))))

    files = spark.read.format("binaryFile").load(path)
    found = [tuple(r) for r in files.select("path", "length").collect()]
    if any(is_remote(at) and not reachable(at) for at, _ in found[:1]):
        return files.select("path", "content").mapInArrow(whole, counted)
    large = [at for at, size in found if split_bytes and size >= 2 * split_bytes]
    tables = pcapng_tables(spark, path, split_bytes, large)
    # small files share a task, as many as Spark's reader would put there or fewer
    share = max(1, min(SPLIT_BYTES, sum(size for _, size in found) // spark.sparkContext.defaultParallelism))
    rows, tasks, total = [], {}, 0
    for at, size in found:
        for i, part in enumerate(splits(at, split_bytes, tables.get(at)) if size >= 2 * split_bytes else [FilePartition(at)]):
            rows.append((at, i, tasks.setdefault(total // share, len(tasks))))
            total += part.stop - part.start or size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(at) as (load, size):
                    yield row(at, part_pieces(load, size, splits(at, split_bytes, tables.get(at))[i]))

    parts = spark.createDataFrame(rows, "path string, part int, task int").repartitionById(max(1, len(tasks)), F.col("task"))
    return parts.mapInArrow(count, counted).groupBy("path").agg(*[F.sum(n).alias(n) for n in names])

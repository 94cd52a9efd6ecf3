"""One capture file in time order, written by all tasks at once.

A record has 40 bytes, or 36 for ICMP, so counts say where everything belongs. Counts by slots of time (finer and finer slots, only where one
has too many packets) give partitions of at most ROWS packets in time order and, as prefix sums of their bytes, the place of each in the file.
Then one shuffle deals packets to their partitions; each task sorts its own and writes at its place. Packets of one
microsecond are split further by hash if they are too many, and ties are ordered by the packet's other fields, so a task that runs
twice, or two attempts at once, write the same bytes. The driver holds the list of partitions only, one for each ROWS packets.

A packet is packed into three numbers before the shuffle: time and protocol, both addresses, both ports with the length.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.metrics import Timer
from packetlens.plans.session import ARROW_ROWS, ship
from packetlens.schema import ICMP, PACKET_COLUMNS, TCP, UDP
from packetlens.sources.capture import FILE_HEADER, RECORD_BYTES, record_bytes

#: Packets of a partition at most; slots of time at first; rows of an Arrow batch.
ROWS, SLOTS, BATCH_ROWS = 1 << 20, 4096, 100_000
#: Protocols by their code in a packed packet.
CODES = [ICMP, TCP, UDP]
MANY = "the packets changed while they were written"


@dataclass
class Slot:
    """Packets of the times [start, stop), or of one microsecond with hash ``share``: how many, and how many of them are ICMP."""

    start: int
    stop: int
    packets: int
    icmp: int
    share: int = -1

    @property
    def bytes(self) -> int:
        return self.packets * RECORD_BYTES[TCP] - self.icmp * (RECORD_BYTES[TCP] - RECORD_BYTES[ICMP])


@dataclass
class Part:
    """A partition: neighbouring slots."""

    start: int
    stop: int
    packets: int
    bytes: int
    at: int
    share: int = -1
    shares: int = 1


def _count(df: DataFrame, slot: Column) -> list:
    """Rows (slot, packets, icmp), in order."""
    icmp = F.sum((F.col("proto") == ICMP).cast("long")).alias("icmp")
    return sorted(df.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("packets"), icmp).collect())


def _spread() -> Column:
    """A number of a packet's fields beside its time."""
    return F.xxhash64(*[c for c in PACKET_COLUMNS if c != "ts"])


def time_slots(df: DataFrame, rows: int = ROWS, slots: int = SLOTS) -> list[Slot]:
    """Slots of at most ``rows`` packets in time order; ``df`` has ``us``. A count over all packets, then one over each crowd of packets that is too large."""
    low, high = df.agg(F.min("us"), F.max("us")).first()
    if low is None:
        return []
    todo, done = [(low, high + 1)], []
    while todo:
        # all slots that are too large are counted in one job: the last of their starts at or before a packet is its own
        wide = [(a, b, max(1, -(-(b - a) // slots))) for a, b in todo]
        inside = F.lit(False)
        number, base = F.lit(None).cast("long"), 0
        bases = []
        for a, b, width in wide:
            here = (F.col("us") >= a) & (F.col("us") < b)
            inside = inside | here
            number = F.when(here, F.lit(base) + F.expr(f"(us - {a}) div {width}")).otherwise(number)
            bases.append((base, a, b, width))
            base += -(-(b - a) // width)
        todo = []
        for slot, packets, icmp in _count(df.where(inside) if len(wide) else df, number):
            first, a, b, width = max(x for x in bases if x[0] <= slot)
            start = a + (slot - first) * width
            stop = min(b, start + width)
            if packets <= rows:
                done.append(Slot(start, stop, packets, icmp))
            elif stop - start > 1:
                todo.append((start, stop))
            else:
                shares = -(-2 * packets // rows)
                found = _count(df.where(F.col("us") == start), F.pmod(_spread(), F.lit(shares)))
                have = {s: (p, i) for s, p, i in found}
                done += [Slot(start, stop, *have.get(s, (0, 0)), share=s) for s in range(shares)]
        # a filter of many ranges would grow with the crowds; the rest of a crowded capture is few ranges of few slots each
        if len(todo) > 64:
            done += [s for a, b in todo[64:] for s in time_slots(df.where((F.col("us") >= a) & (F.col("us") < b)), rows, slots)]
            todo = todo[:64]
    return sorted(done, key=lambda s: (s.start, s.share))


def parts_of(slots: list[Slot], rows: int = ROWS, at: int = len(FILE_HEADER)) -> list[Part]:
    """Neighbouring slots together, up to ``rows`` packets, with their place in the file."""
    out: list[Part] = []
    for s in slots:
        last = out[-1] if out else None
        if last and s.share < 0 and last.share < 0 and last.packets + s.packets <= rows:
            last.stop, last.packets, last.bytes = s.stop, last.packets + s.packets, last.bytes + s.bytes
        else:
            shares = sum(x.start == s.start for x in slots) if s.share >= 0 else 1
            out.append(Part(s.start, s.stop, s.packets, s.bytes, at, s.share, shares))
        at += s.bytes
    return out


def part_number(parts: list[Part], us: Column) -> Column:
    """The partition of a packet: a search by halves over the partitions' first microseconds."""
    first = [i for i, p in enumerate(parts) if p.share <= 0]

    def search(low: int, high: int) -> Column:
        if high - low == 1:
            p = parts[first[low]]
            return F.lit(first[low]) + F.pmod(_spread(), F.lit(p.shares)).cast("int") if p.share == 0 else F.lit(first[low])
        middle = (low + high) // 2
        return F.when(us < parts[first[middle]].start, search(low, middle)).otherwise(search(middle, high))

    return search(0, len(first))


def packed(df: DataFrame) -> list[Column]:
    code = F.when(F.col("proto") == TCP, 1).when(F.col("proto") == UDP, 2).otherwise(F.when(F.col("proto") == ICMP, 0).otherwise(F.raise_error(F.lit("only TCP, UDP and ICMP packets can be written")).cast("int")))
    long = lambda c: F.col(c).cast("long")
    return [
        (F.unix_micros("ts") * 4 + code).alias("a"),
        F.shiftleft(long("src_ip"), 32).bitwiseOR(long("dst_ip")).alias("b"),
        F.shiftleft(long("src_port"), 48).bitwiseOR(F.shiftleft(long("dst_port"), 32)).bitwiseOR(long("length").bitwiseAND(F.lit(0xFFFFFFFF))).alias("c"),
    ]


def in_order(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Packed packets by time, ties by their other fields."""
    order = np.argsort(a, kind="stable")
    a, b, c = a[order], b[order], c[order]
    same = np.concatenate([[False], a[1:] == a[:-1]])
    same[:-1] |= same[1:]
    ties = np.flatnonzero(same)
    if len(ties):
        by = np.lexsort((c[ties], b[ties], a[ties]))
        b[ties], c[ties] = b[ties][by], c[ties][by]
    return a, b, c


def records_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> bytes:
    """Capture records of packed packets."""
    b, c = b.view(np.uint64), c.view(np.uint64)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    proto = np.array(CODES, np.int64)[a & 3]
    return record_bytes(b >> half, b & low, c >> np.uint64(48), (c >> half) & np.uint64(0xFFFF), proto, c & low, a >> 2)


def _writer(path: str, parts: list[Part]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        part = parts[TaskContext.get().partitionId()]
        data = records_of(*in_order(*[np.concatenate([b.column(i).to_numpy() for b in kept]) for i in range(3)]))
        if len(data) != part.bytes:
            raise RuntimeError(MANY)
        with open(path, "r+b") as f:
            f.seek(part.at)
            f.write(data)
        yield pa.RecordBatch.from_pydict({"packets": [part.packets]})

    return write


def write_one_file(df: DataFrame, path: str, rows: int = ROWS, slots: int = SLOTS, timer: Timer | None = None) -> int:
    """The packets of ``df`` as one capture in time order, at a path that the driver and all executors see; returns their number.

    The file has its name once it is whole. ``timer`` gets the time of the counts, which read and filter all packets, as "handling".
    """
    spark = df.sparkSession
    ship(spark)
    timed = df.select(*PACKET_COLUMNS, F.unix_micros("ts").alias("us"))
    with (timer or Timer()).step("handling"):
        parts = parts_of(time_slots(timed, rows, slots), rows)
    temporary = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}")
    n = 0
    try:
        with open(temporary, "wb") as f:
            f.write(FILE_HEADER)
            f.truncate(len(FILE_HEADER) + sum(p.bytes for p in parts))
        if parts:
            dealt = timed.select(*packed(timed), part_number(parts, F.col("us")).alias("part")).repartitionById(len(parts), F.col("part")).select("a", "b", "c")
            before = spark.conf.get(ARROW_ROWS)
            spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
            try:
                n = dealt.mapInArrow(_writer(temporary, parts), "packets long").agg(F.sum("packets")).first()[0] or 0
            finally:
                spark.conf.set(ARROW_ROWS, before)
            if n != sum(p.packets for p in parts):
                raise RuntimeError(MANY)
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)
    return n

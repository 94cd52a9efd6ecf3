"""Results as console tables, CSV time series and single capture files.

Console and CSV rows stream through the driver one partition at a time; a capture is written in place by its tasks.
``write.format("pcap")`` and ``write.csv`` are the forms of many files.
"""

from __future__ import annotations

import csv
import os
import sys
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from packetlens.functions.ip import endpoint
from packetlens.metrics import Timer
from packetlens.operators.engine import PacketFrame
from packetlens.sinks.onefile import write_one_file
from packetlens.sources.pcap import local_path

WIDTHS = (25, 25, 10, 8, 15, 15)
TITLES = ("src IP (: port)", "dst IP (: port)", "protocol", "length", "sec", "usec")


def console_rows(df: DataFrame) -> DataFrame:
    """Six text columns, as the console shows them; from columns ``ts`` and the packet's others."""
    us = F.unix_micros("ts")
    return df.select(
        endpoint(F.col("src_ip"), F.col("src_port"), F.col("proto")).alias("src"),
        endpoint(F.col("dst_ip"), F.col("dst_port"), F.col("proto")).alias("dst"),
        F.col("proto").cast("string").alias("protocol"),
        F.col("length").cast("string").alias("length"),
        F.expr("unix_micros(ts) div 1000000").cast("string").alias("sec"),
        (us % 1_000_000).cast("string").alias("usec"),
    )


def print_packets(frame: PacketFrame, out: TextIO = sys.stdout, timer: Timer | None = None) -> int:
    """The packets in time order under a header; returns their number."""
    line = lambda cells: "".join(str(c).ljust(w) for c, w in zip(cells, WIDTHS, strict=True)) + "\n"
    out.write(line(TITLES))
    n = 0
    for row in _handled(console_rows(frame.df.orderBy("ts")).toLocalIterator(prefetchPartitions=True), timer):
        out.write(line(row))
        n += 1
    return n


def csv_name(frame: PacketFrame, op: str, field: str, interval: int) -> str:
    return f"{frame.canonical()}_{op}_{field}_{interval / 1_000_000:f}secs.csv"


def pcap_name(frame: PacketFrame) -> str:
    return f"{frame.canonical()}.pcap"


def write_csv(series: DataFrame, path: str, timer: Timer | None = None) -> int:
    """An aggregate as one CSV file with header, in slot order."""
    n = 0
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(series.columns)
        for row in _handled(series.orderBy("interval").toLocalIterator(prefetchPartitions=True), timer):
            w.writerow(row)
            n += 1
    return n


def write_pcap(frame: PacketFrame, path: str, timer: Timer | None = None) -> int:
    """The packets in time order as one capture file, written by all tasks at once; returns their number."""
    return write_one_file(frame.df, local_path(path), timer=timer)


def _handled(rows: Iterator[Row], timer: Timer | None) -> Iterator[Row]:
    """Sorted rows; all have been read and filtered when the first one comes."""
    with (timer or Timer()).step("handling"):
        first = next(rows, None)
    if first is not None:
        yield first
        yield from rows


def write_aggregate(frame: PacketFrame, folder: str, op: str = "sum", field: str = "length", interval: int = 1_000_000, timer: Timer | None = None) -> str:
    path = os.path.join(folder, csv_name(frame, op, field, interval))
    write_csv(frame.aggregate(op, field, interval, ordered=False), path, timer)
    return path

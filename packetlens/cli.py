"""Command line: ``ingest`` captures into a store and ``query`` it.

    python -m packetlens.cli ingest -f captures -o store [-b] [-s]        (-l folder follows rotated captures)
    python -m packetlens.cli compact -i store                              (joins the small batches of live ingest)
    python -m packetlens.cli query -i store [-f filter ...] [-p] [-a] [-agOp op] [-agF field] [-agI us] [-o folder] [-v] [-b]

Flags have their short and long spellings; unknown ones are ignored with a warning. A filter is all tokens up to the next flag.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Observation

from packetlens import metrics
from packetlens.operators.engine import OPERATORS, SECOND
from packetlens.plans.dsl import FilterSyntaxError
from packetlens.plans.manifest import vacuum
from packetlens.plans.store import compact_store, read_store, unreadable, write_store
from packetlens.schema import AGGREGATE_FIELDS
from packetlens.sinks.files import pcap_name, print_packets, write_aggregate, write_pcap
from packetlens.sources.pcap import counted_captures
from packetlens.streaming.live import stream_ingest, stream_packets

INGEST = {"output": ("-o", "-out", "-output"), "file": ("-f", "-file"), "live": ("-l", "-live"), "sequential": ("-s", "-sequential"), "benchmark": ("-b", "-benchmark")}
QUERY = {
    "input": ("-i", "-input"), "output": ("-o", "-out", "-output"), "filter": ("-f", "-filter"), "pcap": ("-p", "-pcap"), "verbose": ("-v", "-verbose"), "aggregate": ("-a", "-aggregate"),
    "interval": ("-agI", "-interval", "-intervall"), "operator": ("-agOp", "-operator"), "field": ("-agF", "-field"), "benchmark": ("-b", "-benchmark"),
}
COMPACT = {"input": ("-i", "-input")}
VALUES = {"output", "file", "live", "input", "interval", "operator", "field"}


def options(argv: list[str], flags: dict[str, tuple[str, ...]]) -> dict:
    names = {spelling: name for name, spellings in flags.items() for spelling in spellings}
    out, at = {}, 0
    while at < len(argv):
        name = names.get(argv[at])
        at += 1
        if name is None:
            print(f"ignored: {argv[at - 1]}", file=sys.stderr)
        elif name == "filter":
            tokens = []
            while at < len(argv) and not argv[at].startswith("-"):
                tokens.append(argv[at])
                at += 1
            out[name] = " ".join(tokens)
        elif name in VALUES and at < len(argv) and (name != "live" or not argv[at].startswith("-")):
            out[name] = argv[at]
            at += 1
        else:
            out[name] = True
    return out


def ingest(spark, argv: list[str]) -> int:
    o = options(argv, INGEST)
    if not o.get("output") or not (o.get("file") or o.get("live")):
        print(__doc__, file=sys.stderr)
        return 2
    if o.get("live"):
        query = stream_ingest(stream_packets(spark, o["live"]), o["output"], os.path.join(o["output"], "_progress"))
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            query.processAllAvailable()
            query.stop()
        return 0
    timer, counts = metrics.Timer(), Observation("captures")
    with timer.step("ingest"), metrics.measured(spark, "ingest") as stages:
        write_store(counted_captures(spark, o["file"], counts, strict=False), o["output"])
    size, files = metrics.store_size(spark, o["output"])
    seen = counts.get
    if o.get("benchmark"):
        print(metrics.writer_line(stages, timer.total(), seen["kept"], size, files))
    else:
        print(f"{seen['kept']} packets in {timer.total() / 1e9:.3f} s, {size} bytes in {files} files; {seen['dropped']} of {seen['records']} records dropped, {seen['ipv6']} of them IPv6; {seen['unreadable']} files are no captures")
    return 0


def query(spark, argv: list[str]) -> int:
    o = options(argv, QUERY)
    if not o.get("input"):
        print(__doc__, file=sys.stderr)
        return 2
    operator, field = o.get("operator", "sum"), o.get("field", "length")
    if operator not in OPERATORS:
        print(f"unknown operator {operator}; one of: {', '.join(OPERATORS)}")
        return 0
    if field not in AGGREGATE_FIELDS:
        print(f"unknown field {field}; one of: {', '.join(AGGREGATE_FIELDS)}")
        return 0
    folder = o.get("output", o["input"])
    timer = metrics.Timer()
    try:
        with timer.step("plan"):
            frame = read_store(spark, o["input"], o.get("filter", ""), ignore_corrupt=True)
            if problem := unreadable(frame):
                print(f"warning: the result lacks files that cannot be read: {problem}", file=sys.stderr)
    except FilterSyntaxError as e:
        print(e, file=sys.stderr)
        return 1
    os.makedirs(folder, exist_ok=True)
    with timer.step("output"):
        if o.keys() & {"aggregate", "operator", "field", "interval"}:
            print(write_aggregate(frame, folder, operator, field, int(o.get("interval", SECOND)), timer))
        elif o.get("pcap"):
            path = os.path.join(folder, pcap_name(frame))
            print(f"{write_pcap(frame, path, timer)} packets: {path}")
        else:
            print_packets(frame, timer=timer)
    handling, output = timer.ns["handling"], timer.ns["output"] - timer.ns["handling"]
    if o.get("verbose"):
        size, files = metrics.store_size(spark, o["input"])
        print(f"{files} files, {size} bytes; planning {timer.ns['plan'] / 1e9:.3f} s, reading and filtering {handling / 1e9:.3f} s, output {output / 1e9:.3f} s")
    if o.get("benchmark"):
        print(metrics.reader_line(handling, output))
    return 0


def compact(spark, argv: list[str]) -> int:
    o = options(argv, COMPACT)
    if not o.get("input"):
        print(__doc__, file=sys.stderr)
        return 2
    joined = compact_store(spark, o["input"])
    print(f"{joined} batches joined, {vacuum(spark, o['input'])} removed")
    return 0


def main(argv: list[str]) -> int:
    from packetlens.plans.session import local_session

    commands = {"ingest": ingest, "query": query, "compact": compact}
    if not argv or argv[0] not in commands:
        print(__doc__, file=sys.stderr)
        return 2
    return commands[argv[0]](local_session(), argv[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

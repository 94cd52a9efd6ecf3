"""Filter and aggregate over the packet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions.ip import swap32_col
from packetlens.plans import dsl
from packetlens.plans.capture_filter import compile_capture_filter
from packetlens.schema import ADDRESS_FIELDS, AGGREGATE_FIELDS

OPERATORS = ("sum", "mean", "min", "max", "count", "count_dist")
SECOND = 1_000_000


def slot(ts: str = "ts", interval: int = SECOND) -> Column:
    """Start of the tumbling interval, aligned to the epoch, in microseconds."""
    return F.expr(f"(unix_micros({ts}) div {int(interval)}) * {int(interval)}")


def aggregate_column(op: str, field: str, compat: bool = False, exact_mean: bool = False, approximate: bool = False) -> Column:
    """One of the six aggregates of a field, named ``<op>_<field>``.

    Sums are BIGINT and means truncate; ``exact_mean`` gives doubles, ``approximate`` counts distinct values by
    HyperLogLog. ``compat`` sums modulo 2**32 and computes on byte-swapped addresses.
    """
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}; one of: {', '.join(OPERATORS)}")
    if field not in AGGREGATE_FIELDS:
        raise ValueError(f"unknown field {field!r}; one of: {', '.join(AGGREGATE_FIELDS)}")
    value = F.col(AGGREGATE_FIELDS[field]).cast("long")
    if compat and field in ADDRESS_FIELDS and op in ("sum", "mean", "min", "max"):
        value = swap32_col(value)
    total = F.sum(value)
    if op == "sum":
        out = total % (1 << 32) if compat else total
    elif op == "mean":
        out = F.avg(value) if exact_mean else F.call_function("div", total, F.count(F.lit(1)))
    elif op == "count":
        out = F.count(F.lit(1))
    elif op == "count_dist":
        out = F.approx_count_distinct(value) if approximate else F.count_distinct(value)
    else:
        out = F.min(value) if op == "min" else F.max(value)
    return out.alias(f"{op}_{field}")


class PacketFrame:
    """A DataFrame of packets with the query interface: ``filter(text).aggregate(op, field, interval)``."""

    def __init__(self, df: DataFrame, filter_text: str = "", compat: bool = False, zone: str | None = None):
        self.df, self.compat, self.filter_text = df, compat, filter_text
        self.zone = zone or df.sparkSession.conf.get("spark.sql.session.timeZone") or "UTC"

    def filter(self, text: str) -> PacketFrame:
        tree = dsl.parse(text, self.zone)
        out = self.df.where(dsl.compile_filter(tree, self.compat)) if tree.parts else self.df
        return PacketFrame(out, text, self.compat, self.zone)

    def capture_filter(self, text: str) -> PacketFrame:
        """The packets that a capture filter (pcap-filter syntax) lets through."""
        return PacketFrame(self.df.where(compile_capture_filter(text)), self.filter_text, self.compat, self.zone)

    def canonical(self) -> str:
        return dsl.parse(self.filter_text, self.zone).canonical()

    def aggregate(self, op: str = "sum", field: str = "length", interval: int = SECOND, ordered: bool = True, fill_gaps: bool = False, **how: bool) -> DataFrame:
        """interval, <op>_<field>, sorted by slot.

        Partial sums in the scan's stage and one exchange on the slot; ``count_dist`` takes two, first on slot and value.
        ``fill_gaps`` adds the empty slots between the first and the last, which it looks up first.
        """
        out = self.df.groupBy(slot(interval=interval).alias("interval")).agg(aggregate_column(op, field, self.compat, **how))
        if fill_gaps:
            low, high = self.df.select(slot(interval=interval).alias("s")).agg(F.min("s"), F.max("s")).first()
            slots = self.df.sparkSession.range(low or 0, 0 if low is None else high + interval, interval)
            out = slots.withColumnRenamed("id", "interval").join(out, "interval", "left")
        return out.orderBy("interval") if ordered else out

    def ordered(self) -> DataFrame:
        return self.df.orderBy("ts")

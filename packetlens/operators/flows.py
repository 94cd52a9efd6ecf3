"""Flow and host roll-ups, sessions, grouped packet vectors, and exact distinct counts that merge."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIVE_TUPLE = ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]


def host_key() -> Column:
    """The address a packet is clustered by: the smaller end, so both directions of a pair meet."""
    return F.least("src_ip", "dst_ip")


def flow_rollup(df: DataFrame) -> DataFrame:
    """Packets, bytes, first and last time of each directed 5-tuple."""
    us = F.unix_micros("ts")
    return df.groupBy(*FIVE_TUPLE).agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def host_clusters(df: DataFrame) -> DataFrame:
    """Each host's packets, distinct peers, first and last time."""
    us = F.unix_micros("ts")
    return df.groupBy(host_key().alias("host")).agg(
        F.count(F.lit(1)).alias("packets"), F.count_distinct(F.greatest("src_ip", "dst_ip")).alias("peers"), F.min(us).alias("first_us"), F.max(us).alias("last_us")
    )


#: Idle time that ends a flow's session; packets of a group; groups do not go beyond such a slot of time.
IDLE, GROUP_PACKETS, GROUP_SLOT = 60_000_000, 32, 3_600_000_000


def flow_sessions(df: DataFrame, keys: list[str] = FIVE_TUPLE, idle_us: int = IDLE) -> DataFrame:
    """Packets, bytes, first and last time of each session: a flow's packets with at most ``idle_us`` between neighbours.

    Also over a stream with a watermark, in append mode: a session leaves the state once the watermark has passed its idle time.
    """
    us = F.unix_micros("ts")
    session = F.session_window("ts", f"{idle_us} microseconds").alias("session")
    out = df.groupBy(*keys, session).agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    return out.drop("session")


def packet_groups(df: DataFrame, keys: list[str] = FIVE_TUPLE, idle_us: int = IDLE, size: int = GROUP_PACKETS, slot_us: int = GROUP_SLOT) -> DataFrame:
    """Grouped packet vectors: keys, first_us, packets and, in time order, an array of what else the packets have (``offset_us`` from the first, length, other columns).

    A group ends after ``size`` packets, before an idle time, and where a slot of time ends; the last lets a busy flow be dealt
    by slots, so its packets are no single task's.
    """
    us = F.unix_micros("ts")
    rest = [c for c in df.columns if c not in keys and c != "ts"]
    slot = F.call_function("div", us, F.lit(slot_us))
    timed = df.select(*keys, *rest, us.alias("us"), slot.alias("slot"))
    flow = Window.partitionBy(*keys, "slot").orderBy("us", *rest)
    pause = F.coalesce(F.col("us") - F.lag("us").over(flow) > idle_us, F.lit(False)).cast("int")
    marked = timed.withColumns({"pause": pause, "n": F.row_number().over(flow)})
    sessions = marked.withColumn("session", F.sum("pause").over(flow.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min("n").over(Window.partitionBy(*keys, "slot", "session"))
    grouped = sessions.withColumn("part", F.call_function("div", F.col("n") - first, F.lit(size)))
    items = F.array_sort(F.collect_list(F.struct("n", "us", *rest)))
    made = grouped.groupBy(*keys, "slot", "session", "part").agg(F.min("us").alias("first_us"), F.count(F.lit(1)).alias("packets"), items.alias("items"))
    vector = F.transform("items", lambda x: F.struct((x["us"] - F.col("first_us")).alias("offset_us"), *[x[c].alias(c) for c in rest]))
    return made.select(*keys, "first_us", "packets", vector.alias("items"))


def ungrouped(groups: DataFrame) -> DataFrame:
    """The packets of ``packet_groups``."""
    keys = [c for c in groups.columns if c not in ("first_us", "packets", "items")]
    flat = groups.select(*keys, "first_us", F.explode("items").alias("item")).select(*keys, F.timestamp_micros(F.col("first_us") + F.col("item.offset_us")).alias("ts"), "item.*")
    return flat.drop("offset_us")


def address_bitmaps(df: DataFrame, column: str, slot: Column) -> DataFrame:
    """interval, bucket, bitmap: the distinct values of a column in each slot, exactly, a bit a value.

    Bitmaps have 4 KB and merge by ``merged_bitmaps``, so hours add up to days without the packets, and a stream's state
    holds at most 512 MB a slot (all addresses there are) however often they come.
    """
    value = F.col(column).cast("long")
    return df.groupBy(slot.alias("interval"), F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bitmap"))


def merged_bitmaps(bitmaps: DataFrame, interval: int) -> DataFrame:
    """The bitmaps of longer slots, of ``interval`` microseconds."""
    wide = F.expr(f"(interval div {int(interval)}) * {int(interval)}")
    return bitmaps.groupBy(wide.alias("interval"), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_counts(bitmaps: DataFrame, name: str) -> DataFrame:
    """interval and the number of distinct values."""
    return bitmaps.groupBy("interval").agg(F.sum(F.bitmap_count("bitmap")).alias(name))

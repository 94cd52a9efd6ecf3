"""Line dedup by site-relative frequency.

For each host, the share of its pages that contain a line. Lines above the boilerplate ratio (and on a
minimum number of pages, so that hosts with a few pages keep their text) are dropped from every page of
the host. Counting sends a 128-bit line key for each distinct line of a page, pre-aggregated in each task,
so a hot line or host costs one row a task; the lines found are at most (mean distinct lines of a page) /
ratio for each host. They are regrouped to one row a host and joined to the pages: that side is
broadcast if its measured size allows; else Spark splits skewed hosts.

Defined results: lines are split at newlines and compared whole; lines without a character other than
ASCII white space are neither counted nor dropped. A null text stays null; a null host is a host of its
own. Repeated rows count as pages each. A page that loses every line keeps an empty text. All other columns
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, settle, table

RATIO = 0.01
LEAST_PAGES = 5
#: The lines to drop are broadcast up to this measured size; beyond it the join shuffles by host.
SMALL_BYTES = 10 << 20


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row a host that has boilerplate: host and the keys of the lines to drop."""
    lines = F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _has_word))
    pages = df.select(F.col(host).alias("host"), lines.alias("lines"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    keyed = pages.select("host", F.explode("lines").alias("line")).select("host", _key(F.col("line")).alias("k"))
    counts = keyed.groupBy("host", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    counts = counts.withColumnRenamed("host", OWN + "h")
    over = counts.join(total, counts[OWN + "h"].eqNullSafe(total["host"])).where(F.col("n") > ratio * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("k").alias("keys"))


def line_dedup(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: bool = False) -> DataFrame:
    """``df`` without boilerplate lines; with ``counts``, n_lines and n_dropped are added."""
    drop = settle(boilerplate(df, host, text, ratio, least_pages).select(F.col("host").alias(OWN + "host"), F.col("keys").alias(OWN + "keys")))
    size = drop.agg(F.coalesce(F.sum(64 + 32 * F.size(OWN + "keys")), F.lit(0))).first()[0]
    drop = F.broadcast(drop) if size <= SMALL_BYTES else drop
    joined = df.join(drop, df[host].eqNullSafe(drop[OWN + "host"]), "left")
    lines = F.split(F.col(text), "\n")
    # the keys that this page has, found by hashing, are few; only then lines are tested against them
    here = F.array_intersect(F.col(OWN + "keys"), F.transform(lines, _key))
    found = joined.withColumn(OWN + "here", F.when(F.col(OWN + "keys").isNotNull(), here))
    hit = F.coalesce(F.size(OWN + "here") > 0, F.lit(False))
    keep = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col(OWN + "here"), _key(x)))
    found = found.withColumn(OWN + "kept", F.when(hit, keep))
    if counts:
        n = F.coalesce(F.size(lines), F.lit(0))
        found = found.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(n).cast("long"), "n_dropped": F.when(hit, n - F.size(OWN + "kept")).otherwise(0).cast("long")})
    return found.withColumn(text, F.when(hit, F.array_join(OWN + "kept", "\n")).otherwise(F.col(text))).drop(OWN + "host", OWN + "keys", OWN + "here", OWN + "kept")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs, counts=True).select("doc_id", "n_lines", "n_dropped", "text")


def lines_ctes(source: str = "documents") -> str:
    """CTEs ending in ``deduped``: the rows of ``source`` with ``clean`` text, n_lines and n_dropped."""
    return f"""
r10 AS (SELECT *, row_number() OVER () AS rid, string_split(text, chr(10)) AS ls FROM {source}),
e10 AS (SELECT rid, source, unnest(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS line FROM r10),
n10 AS (SELECT source, count(*) AS pages FROM r10 GROUP BY source),
b10 AS (SELECT e.source, line FROM e10 e JOIN n10 n ON e.source IS NOT DISTINCT FROM n.source GROUP BY e.source, line, pages
        HAVING count(*) >= {LEAST_PAGES} AND count(*) > {RATIO}::DOUBLE * pages),
h10 AS (SELECT source, list(line) AS drops FROM b10 GROUP BY source),
k10 AS (SELECT r.*, CASE WHEN drops IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(drops, x)) END AS keep
        FROM r10 r LEFT JOIN h10 h ON r.source IS NOT DISTINCT FROM h.source),
deduped AS (SELECT *, array_to_string(keep, chr(10)) AS clean, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
                   CAST(coalesce(len(ls) - len(keep), 0) AS BIGINT) AS n_dropped FROM k10)"""


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {"op10_line_dedup": f"WITH {lines_ctes()} SELECT doc_id, n_lines, n_dropped, clean AS text FROM deduped"}

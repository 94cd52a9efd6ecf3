"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 36-bit hash of its id. A source whose target is ``k + f`` times its size is
taken ``k`` times whole and once more below a hash threshold that holds the rest of the budget. The
threshold is found without sorting: word counts are summed by source and the first 12 hash bits, the one
bucket in which the budget ends is opened by the next 12 bits, and again, so each round reads only what
the round before left open. Sums are partial before every shuffle, so a hot source costs one row for
each bucket and task. The table with a row for each source may be large too: its order comes from a range shuffle with the
rows before each partition, and the common level from a few sums over it, so no task sees all sources.

Defined results: a null text has size 0; sources are ordered by code point with null last and get the
weights in turn. Documents with equal ids share a hash and are taken together. An empty table, or one
without words, gives targets of 0. A null id is hashed like an empty string. Columns of the input other
than id, text and source are not read; ``mixed_rows`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, settle, sized, table, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
LEVEL_HEX, LEVELS = 3, 3


def doc_hash(doc_id: Column) -> Column:
    """The first 36 bits of the id's MD5, the same in any engine and run."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, LEVEL_HEX * LEVELS)
    return F.conv(digits, 16, 10).cast("long")


def _numbered(sums: DataFrame) -> DataFrame:
    """``sums`` with the place ``n`` of each source in code point order, null last."""
    ranged = settle(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, starts = 0, []
    for r in sorted(ranged.groupBy("part").count().collect()):  # a row for each partition
        starts.append((r["part"], before))
        before += r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    start = F.create_map(*[F.lit(x).cast("long") for pair in starts for x in pair]) if starts else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return ranged.withColumn("n", place + start[F.col("part").cast("long")]).drop("part")


def source_targets(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, target.

    Water level: all sources get weight * level; those beyond their cap get their cap, what they leave raises the level
    of the others, and so on until none is above. Each round is one sum over the sources.
    """
    numbered = _numbered(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    filled = settle(numbered.select("source", "source_size", w.alias("w"), (F.col("source_size") * max_epochs).alias("cap")))
    total, all_w = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    left_size, left_w, capped = total, all_w, 0
    while True:
        over = F.lit(left_size).cast("decimal(20,0)") * F.col("w") > F.col("cap").cast("decimal(20,0)") * F.lit(left_w).cast("decimal(18,0)")
        caps, ws, n = filled.where(over).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0)), F.count(F.lit(1))).first()
        if n == capped or ws == all_w:
            break
        left_size, left_w, capped = total - caps, all_w - ws, n
    share = (F.col("w") * F.lit(left_size)).cast("double") / F.lit(left_w or 1)
    return filled.select("source", "source_size", F.when(over, F.col("cap").cast("double")).otherwise(share).alias("target"))


def hash_thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with ``epochs`` (whole passes) and ``threshold``: hashes below it are taken once more.

    The state has for each source the start of its open bucket, the words below it and whether a bucket is
    open. Up to the last level the budget ends in the first bucket whose running sum exceeds it; there
    the nearer side of the single hash value is taken.
    """
    ratio = F.col("target") / F.col("source_size")
    state = (
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumns({"base": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "open": F.lit(True)})
    )
    state, rows = settle(state), docs
    for level in range(LEVELS):
        unit, last = 16 ** (LEVEL_HEX * (LEVELS - 1 - level)), level == LEVELS - 1
        keyed = rows.withColumn("bucket", F.expr(f"h div {unit}"))
        sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
        joined = sums.join(state, sums["source"].eqNullSafe(state["source"])).drop(state["source"])
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
        run = joined.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("s"))
        fits = (F.col("start") + F.col("upto") <= 2 * F.col("budget")) if last else (F.col("upto") <= F.col("budget"))
        cut = run.where(~fits).groupBy("source").agg(F.min(F.struct("bucket", "start")).alias("cut"))
        cut = cut.withColumnRenamed("source", OWN + "s")
        out = state.join(cut, state["source"].eqNullSafe(cut[OWN + "s"]), "left")
        end = F.col("base") + unit * 16**LEVEL_HEX
        state = settle(
            out.select(
                "source", "source_size", "target", "epochs", "budget",
                F.when(~F.col("open"), F.col("base")).when(F.col("cut").isNull(), end).otherwise(F.col("cut.bucket") * unit).alias("base"),
                F.coalesce(F.col("cut.start"), F.col("below")).alias("below"),
                (F.col("open") & F.col("cut").isNotNull()).alias("open"),
            )
        )
        if not last:
            edge = state.where("open").select(F.col("source").alias(OWN + "s"), F.expr(f"base div {unit}").alias(OWN + "b"))
            rows = keyed.join(edge, keyed["source"].eqNullSafe(F.col(OWN + "s")) & (F.col("bucket") == F.col(OWN + "b"))).select("source", "size", "h")
    return state.select("source", "source_size", "target", "epochs", F.col("base").alias("threshold"))


def mixing_plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, source, size, h) and one row a source with target, epochs and threshold."""
    sized_docs = settle(df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), doc_hash(F.col(doc_id)).alias("h")))
    return sized_docs, hash_thresholds(sized_docs, source_targets(sized_docs, weights, max_epochs)).withColumnRenamed("source", OWN + "s")


def _copies(h: Column, epochs: str, threshold: str, max_epochs: int) -> Column:
    """How often a document is taken; a document without words is below any threshold, so the limit is stated."""
    return F.least(F.col(epochs) + (h < F.col(threshold)).cast("long"), F.lit(max_epochs).cast("long"))


def mix_sources(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies (times taken), taken (words)."""
    docs, plan = mixing_plan(df, doc_id, text, source, weights, max_epochs)
    return (
        docs.join(sized(plan), docs["source"].eqNullSafe(F.col(OWN + "s")))
        .withColumn("copies", _copies(F.col("h"), "epochs", "threshold", max_epochs))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``df`` as the mix takes it: rows left out, kept or repeated. The texts are not shuffled."""
    _, plan = mixing_plan(df, doc_id, text, source, weights, max_epochs)
    plan = sized(plan.select(OWN + "s", F.col("epochs").alias(OWN + "e"), F.col("threshold").alias(OWN + "t")))
    copies = _copies(doc_hash(F.col(doc_id)), OWN + "e", OWN + "t", max_epochs)
    rows = df.join(plan, F.col(source).cast("string").eqNullSafe(F.col(OWN + "s"))).withColumn(OWN + "n", copies).where(F.col(OWN + "n") > 0)
    return rows.withColumn(OWN + "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col(OWN + "n")))).select(*df.columns)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_ctes(source: str = "documents") -> str:
    """CTEs ending in ``mixed``: every row of ``source`` with size, source_size, target, copies and taken.

    The threshold is found by a sorted running sum here, independent of the histograms.
    """
    ws = ", ".join(str(w) for w in WEIGHTS)
    return f"""
d AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {LEVEL_HEX * LEVELS})) AS BIGINT) AS h FROM {source}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [{ws}][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)}] AS w FROM d GROUP BY source),
c AS (SELECT *, {MAX_EPOCHS} * source_size AS cap, row_number() OVER (ORDER BY CAST({MAX_EPOCHS} * source_size AS DOUBLE) / w, source ASC NULLS LAST) AS n FROM s),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_size,
             CAST((SELECT sum(w) FROM s) - coalesce(sum(w) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_w FROM c),
a AS (SELECT n AS an, left_size AS al, left_w AS aw FROM l WHERE left_size * w <= cap * left_w ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN an IS NULL OR n < an THEN CAST(cap AS DOUBLE) ELSE CAST(w * al AS DOUBLE) / aw END AS target FROM l LEFT JOIN a ON TRUE),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
j AS (SELECT d.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS own
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
mixed AS (SELECT *, size * copies AS taken FROM (SELECT *, least(epochs + CASE WHEN upto + upto - own <= 2 * budget THEN 1 ELSE 0 END, {MAX_EPOCHS}) AS copies FROM j))"""


def mixing_sql() -> str:
    return f"WITH {mixing_ctes()} SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM mixed"


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLES = {"op3_mix_sources": mixing_sql()}

"""URL filters: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models (contexts of 0 to 3 characters, Witten-Bell interpolation) are
trained on the URLs that the rules allow and block. A URL without a rule is judged by the difference of
their log-likelihoods divided by its length, against a threshold calibrated on labelled URLs that the models
have not seen (one in five, by hash).

Every labelled URL but the one in five held out for the threshold is counted: n-grams are counted in each Arrow
batch, summed by Spark, and the sums come to the driver. Bytes are folded to 48 symbols, all non-ASCII bytes and
rare punctuation to one, so there are at most 48**4 n-grams of each class: what is learned stops growing there,
and URLs that differ only in such bytes score alike. The broadcast table of log ratios is 21 MB. Scoring is a narrow map.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and scores 0.
Without allowed or without blocked examples every URL without a rule is allowed. Repeated rows are judged
one by one; columns named host, path, rule, score or verdict are replaced, other columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import OWN, ship, table

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%#:"
OTHER, START, SIZE = len(SYMBOLS), len(SYMBOLS) + 1, len(SYMBOLS) + 2
ORDER = 4
BIN = 0.01
MOST_BINS = 2000
HELD_OUT = 5

_CODE = np.full(256, OTHER, np.int64)
for _i, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i


class Rule(NamedTuple):
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/")]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; else empty."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")


def url_host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def url_path(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def rule_for(host: Column, path: Column, rules: list[Rule] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


# --- the models ---------------------------------------------------------------------------


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram of each byte of each text (three start symbols before), and the texts' byte lengths."""
    raw = [x.as_py().encode() for x in texts]
    lengths = np.array([len(x) for x in raw], np.int64)
    codes = _CODE[np.frombuffer(b"".join(raw), np.uint8)]
    row = np.repeat(np.arange(len(raw)), lengths)
    at = np.arange(len(codes)) + (ORDER - 1) * (row + 1)
    padded = np.full(len(codes) + (ORDER - 1) * len(raw), START, np.int64)
    padded[at] = codes
    g = padded[at - (ORDER - 1)]
    for k in range(ORDER - 2, -1, -1):
        g = g * SIZE + padded[at - k]
    return g, lengths


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g, lengths = grams(batch.column(0))
        label = np.repeat(np.asarray(batch.column(1)), lengths)
        key, n = np.unique(label * SIZE**ORDER + g, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell interpolated log P(last | up to three before) for every 4-gram."""
    counts = counts.reshape((SIZE,) * ORDER)
    p = np.full(SIZE, 1 / SIZE, np.float32)
    for order in range(1, ORDER + 1):
        c = counts.sum(axis=tuple(range(ORDER - order)), dtype=np.float32) if order < ORDER else counts
        total = c.sum(axis=-1, keepdims=True)
        kinds = (c > 0).sum(axis=-1, keepdims=True).astype(np.float32)
        seen = np.maximum(total + kinds, 1)
        p = np.where(total > 0, (c + kinds * p) / seen, p).astype(np.float32)
    return np.log(p).reshape(-1)


def scores(ratio: np.ndarray, texts: pa.Array) -> np.ndarray:
    g, lengths = grams(texts)
    out = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        first = (np.cumsum(lengths) - lengths)[some]
        out[some] = np.add.reduceat(ratio[g].astype(np.float64), first) / lengths[some]
    return out


def url_model(labelled: DataFrame) -> tuple[np.ndarray, float] | None:
    """Log-ratio table and threshold from rows (rest, label 0 or 1); None without both labels."""
    spark = labelled.sparkSession
    fold = labelled.withColumn("held", F.pmod(F.xxhash64("rest"), F.lit(HELD_OUT)) == 0)
    train = fold.where(~F.col("held")).select("rest", "label").mapInArrow(_counter, "key long, n long")
    rows = train.groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * 48**4 rows, as columns
    counts = np.zeros((2, SIZE**ORDER), np.float32)
    keys = rows["key"].to_numpy()
    counts[keys // SIZE**ORDER, keys % SIZE**ORDER] = rows["n"].to_numpy()
    if not counts[0].any() or not counts[1].any():
        return None
    ratio = log_probabilities(counts[1])
    ratio -= log_probabilities(counts[0])
    shared = spark.sparkContext.broadcast(ratio)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.clip(np.floor(scores(shared.value, batch.column(0)) / BIN), -MOST_BINS, MOST_BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b), batch.column(1)], ["bin", "label"])

    held = fold.where("held").select("rest", "label").mapInArrow(binned, "bin long, label long").groupBy("bin", "label").count().collect()
    good, bad = ({r["bin"]: r["count"] for r in held if r["label"] == x} for x in (1, 0))
    best, threshold = -1.0, 0.0
    for cut in sorted({*good, *bad, 0}, key=lambda b: (abs(b), b)):
        kept = sum(n for b, n in good.items() if b >= cut) / max(1, sum(good.values()))
        stopped = sum(n for b, n in bad.items() if b < cut) / max(1, sum(bad.values()))
        if kept + stopped > best:
            best, threshold = kept + stopped, cut * BIN
    return ratio, threshold


def filter_urls(df: DataFrame, url: str = "url", rules: list[Rule] = RULES) -> DataFrame:
    """``df`` with host, path, rule, score and verdict."""
    spark = df.sparkSession
    ship(spark)
    rest = OWN + "rest"
    judged = df.withColumn(rest, url_rest(F.col(url)))
    judged = judged.withColumns({"host": url_host(F.col(rest)), "path": url_path(F.col(rest))})
    judged = judged.withColumn(OWN + "rule", rule_for(F.col("host"), F.col("path"), rules))
    labelled = judged.where(F.col(OWN + "rule").isNotNull()).select(F.col(rest).alias("rest"), (F.col(OWN + "rule.verdict") == "allow").cast("long").alias("label"))
    model = url_model(labelled)
    ratio, threshold = model if model else (np.zeros(1, np.float32), 0.0)
    shared = spark.sparkContext.broadcast(ratio)
    plain = model is None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(rest)
            s = np.zeros(batch.num_rows) if plain else scores(shared.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, OWN + "score"])

    schema = StructType([*judged.schema.fields, StructField(OWN + "score", DoubleType())])
    out = judged.mapInArrow(score, schema)
    return out.withColumns(
        {
            "rule": F.col(OWN + "rule.rule"),
            "score": F.col(OWN + "score"),
            "verdict": F.coalesce(F.col(OWN + "rule.verdict"), F.when(F.col(OWN + "score") >= threshold, "allow").otherwise("block")),
        }
    ).drop(rest, OWN + "rule", OWN + "score")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES: dict[str, str] = {}

"""Exact n-gram Jaccard self-join in the metric space of shingle sets (distance d = 1 - J, links at d <= 1/4).

1. *Sets.* A pass hashes each whole text's distinct 5-word shingles to 64 bits and names the set by a
   88-bit digest; exact copies are one point of the space from here on. It also makes each set's bitmap,
   two to four bits a shingle: bits that one bitmap has beyond another prove a distance from below.
2. *Outer regions.* The outer pivots are single shingles. {s} is at distance below 1 of the sets that have s
   and at exactly 1 of all others, so a set's region windows are its shingles. Under any one global order of the
   shingles a linked pair shares one among the first n - ceil(3n/4) + 1 of each set: a set is replicated to
   these windows only. The order is rarest first: shingles that the first pass met more than MANY times come
   last, by a logarithmic class of their count, so common lines and passages open no regions for texts that merely
   quote them. (It counts what a chunk of texts has twice or more; a wrong rank costs
   time, never a link.) Since linked sizes differ by a factor of 3/4 at most, a region falls into size classes
   of that width, each with its own sets and those of the class below. Regions of the same members are one region.
3. *Voronoi cells.* In each region 1, then 8, 512, ... sets become pivots, first of different components.
   Every other set of the region is held against the pivots of other components, first by the bitmaps; what these
   leave is measured exactly. Pivots leave the region; linked sets are one component and no pair of a component is
   looked at again. A set within 1/4 of pivots is at home in the cell of the nearest one, q. With r the radius of the cell, a set
   elsewhere can be linked into it only if d(b, q) <= r + 1/4: the sets of other components in this triangle window are
   replicated into the cell. Sets without a home stay in the region. Cells and regions join again, until none has two components.
   Sets with too few window shingles from the region's on to be linked there leave at once: a set must reach 3/7 of both sizes
   with what it has from the region's shingle on, and share window shingles enough with sets of a fitting size.
   A region whose sets all have the same region before goes too, and sets with the same one are not compared: they meet there.
4. *Components* of the links by alternating large and small stars.

Keys are never gathered in one task: windows of frequent shingles are salted, pivots and bounds of regions are
aggregates with partial sums, and the joins by region are ones that Spark can split. Cells of a region are made only for
HUBS pivots a round and where they take at most as many copies as the region has sets, so that members grow linearly.
Superseded tables are deleted. Nothing about all documents comes to the driver; broadcast are the frequent shingles, at most
2**22 since a shingle needs 1 / 2**22 of all occurrences, and tables of a measured number of rows or bytes.

Defined results: a null or wordless text has an empty set, links with nothing and is its own component.
Fewer than five words are one shingle. Repeated rows and rows with equal ids are one class each; the
component id is the smallest id, nulls aside, of the component. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, Scratch, ship, sized, table

WORDS = 5
PERCENT = 75
MANY = 16
MOST_FREQUENT = 1 << 22
PIVOTS_TIMES = 8
HUBS = 4
#: Window rows of shingles with a count of 2**HOT or more are dealt to SALTS tasks.
HOT = 12
SALTS = 64
#: Tables of a round are broadcast up to so many measured rows, whole sets and bitmaps up to so many bytes; beyond, joins shuffle.
SMALL_ROWS = 50_000
SMALL_BYTES = 4 << 20
DIGEST_BYTES = 11
CHUNK = 1 << 22
ROWS_AT_ONCE = 1 << 16
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M1
    return x ^ (x >> _S)


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_hashes(raw: bytes | memoryview) -> np.ndarray:
    """64-bit hashes of the lower-cased words of UTF-8 bytes; long texts in pieces, words never cut."""
    if len(raw) <= PIECE:
        return _hashed(bytes(raw).lower().split())  # of bytes: A-Z and ASCII white space only
    out, rest, raw = [], b"", memoryview(raw)
    for start in range(0, len(raw), PIECE):
        piece = bytes(raw[start : start + PIECE])
        words = piece.lower().split()
        if words and not piece[:1].isspace():
            words[0] = rest + words[0]
        elif rest:
            words.insert(0, rest)
        rest = words.pop() if not piece[-1:].isspace() else b""
        out.append(_hashed(words))
    return np.concatenate([*out, _hashed([rest] if rest else [])])


def shingle_sets(texts: list[bytes | memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one set after the other, and where each begins and the last ends."""
    words = [word_hashes(t) for t in texts]
    lengths = np.array([len(w) for w in words])
    takes = np.where(lengths >= WORDS, WORDS, lengths)
    counts = np.where(lengths > 0, lengths - takes + 1, 0)
    h = np.concatenate([*words, np.zeros(WORDS, np.uint64)])
    first = np.cumsum(lengths) - lengths
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], counts)
    s = np.full(ends[-1], WORDS, np.uint64)
    for j in range(WORDS):
        s = s * _BASE + h[at + j]
    for i in np.flatnonzero((lengths > 0) & (lengths < WORDS)):  # one shingle of all words there are
        short = np.full(1, lengths[i], np.uint64)
        for x in words[i]:
            short = short * _BASE + x
        s[ends[i]] = short[0]
    s = _mix(s)
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[ends[:-1][counts > 0]] = True
    before = np.concatenate([[0], np.cumsum(new)])
    return s[new], before[ends]


def shingle_set(text: bytes | memoryview) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    return shingle_sets([text])[0]


def _set_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """The first row, the sets and their bounds for some texts after the other, of bounded size but for one long text."""
    some, size, first = [], 0, 0
    for row in range(len(texts)):
        some.append(_raw(texts, row))
        size += len(some[-1])
        if size > PIECE or row == len(texts) - 1:
            s, ends = shingle_sets(some)
            yield first, s, ends.tolist()
            some, size, first = [], 0, row + 1


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=DIGEST_BYTES).digest()


def bitmap(s: np.ndarray) -> bytes:
    """Two to four bits a shingle, a power of two of them; the hash's low bits name the bit."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def most_shared(a: bytes, b: bytes, an: int, bn: int) -> int:
    """At most so many shingles are in both sets: each bit that one bitmap has beyond the other is a shingle of its own."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(an - int(np.bitwise_count(x & ~y).sum()), bn - int(np.bitwise_count(y & ~x).sum()))


def _raw(texts: pa.Array, row: int) -> memoryview:
    value = texts[row]
    return memoryview(value.as_buffer() if value.is_valid else b"")


def window_size(n):
    """How many leading shingles of n a linked set must share one of."""
    return n - (n * PERCENT + 99) // 100 + 1


def _scan(kind: str):
    """First pass: rows of texts (doc_id, n, key, bits, th), and counts (s, c) of shingles that a chunk of texts has twice."""
    names = ["doc_id", "n", "key", "bits", "th", "s", "c"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, filled, seen = np.empty(CHUNK, np.uint64), 0, set()
        id_type = pa.int64()

        def counted() -> Iterator[pa.RecordBatch]:
            values = chunk[:filled]
            values.sort()
            again = np.flatnonzero(values[1:] == values[:-1])  # few: memory goes to the values only
            first = np.flatnonzero(np.diff(again, prepend=-2) != 1)
            s, c = values[again[first]].view(np.int64), np.diff(np.append(first, len(again))) + 1
            for i in range(0, len(s), ROWS_AT_ONCE):
                part = s[i : i + ROWS_AT_ONCE]
                none = [pa.nulls(len(part), t) for t in (id_type, *types[:4])]
                yield pa.RecordBatch.from_arrays([*none, pa.array(part), pa.array(c[i : i + ROWS_AT_ONCE], pa.int64())], names)

        for batch in batches:
            id_type, n, keys, bits = batch.column(0).type, [], [], []
            for _, values, ends in _set_chunks(batch.column(1)):
                for a, b in zip(ends, ends[1:], strict=False):
                    s = values[a:b]
                    n.append(len(s))
                    keys.append(key := digest(s))
                    bits.append(bitmap(s) if len(s) else None)
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    for i in range(0, len(s), CHUNK):
                        part = s[i : i + CHUNK]
                        if filled + len(part) > CHUNK:
                            yield from counted()
                            filled, seen = 0, {key}
                        chunk[filled : filled + len(part)] = part
                        filled += len(part)
            none = [pa.nulls(len(keys), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary()), batch.column(2), *none], names)
        if filled:
            yield from counted()

    return run, f"doc_id {kind}, n long, key binary, bits binary, th long, s long, c long"


def _windows(frequent):
    """Second pass: (s, key, n, after, hot) for the shingles whose windows a set is replicated to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = frequent.value
        parts, hot, keys, sizes, counts, size, seen = [], [], [], [], [], 0, set()
        for batch in batches:
            for _, values, ends in _set_chunks(batch.column(0)):
                at = np.minimum(np.searchsorted(often, values), max(len(often) - 1, 0))
                rank = np.where(often[at] == values, level[at], 0).astype(np.int8) if len(often) else np.zeros(len(values), np.int8)
                common = np.concatenate([[0], np.cumsum(rank > 0)])
                for a, b in zip(ends, ends[1:], strict=False):
                    if a == b or (key := digest(values[a:b])) in seen:
                        continue
                    if len(seen) >= ROWS_AT_ONCE:  # a repeat costs time only
                        seen.clear()
                    seen.add(key)
                    counts.append(window_size(b - a))
                    order = np.argsort(rank[a:b], kind="stable")[: counts[-1]] + a if common[b] > common[a] else slice(a, a + counts[-1])
                    parts.append(values[order])
                    hot.append(rank[order] >= HOT)
                    keys.append(key)
                    sizes.append(b - a)
                    size += counts[-1]
                    if size > 1 << 18:
                        yield _window_rows(parts, hot, keys, sizes, counts)
                        parts, hot, keys, sizes, counts, size = [], [], [], [], [], 0
        if parts:
            yield _window_rows(parts, hot, keys, sizes, counts)

    return run


def _window_rows(parts: list, hot: list, keys: list, sizes: list, counts: list) -> pa.RecordBatch:
    at = np.repeat(np.arange(len(keys)), counts)
    behind = np.concatenate([np.arange(c, 0, -1, dtype=np.int32) for c in counts])  # window shingles from this one on
    cols = [pa.array(np.concatenate(parts).view(np.int64)), pa.array(keys, pa.binary()).take(pa.array(at)), pa.array(np.array(sizes, np.int32)[at]), pa.array(behind), pa.array(np.concatenate(hot))]
    return pa.RecordBatch.from_arrays(cols, ["s", "key", "n", "after", "hot"])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, an, bn, most) of pairs with their bitmaps."""
    for batch in batches:
        most = [most_shared(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("abits", "bbits", "an", "bn")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "an", "bn")), pa.array(most, pa.int64())], ["a", "b", "an", "bn", "most"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets of the texts whose digest is the wanted one."""

    def packed(batch: pa.RecordBatch, rows: list, sets: list) -> pa.RecordBatch:
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in (1, 2, 3)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets), pa.int64()))], ["key", "is_a", "is_b", "items"])

    for batch in batches:
        wanted = batch.column(1).to_pylist()
        for first, values, ends in _set_chunks(batch.column(0)):
            rows, sets = [], []
            for row, (a, b) in enumerate(zip(ends, ends[1:], strict=False), first):
                if digest(values[a:b]) == wanted[row]:
                    rows.append(row)
                    sets.append(values[a:b].view(np.int64))
            if sets:
                yield packed(batch, rows, sets)


def _hint(rows: int):
    """How to join a table that is known to have so many rows at most."""
    return F.broadcast if rows <= SMALL_ROWS else lambda df: df


def components(links: DataFrame) -> DataFrame:
    """(key, root) for every end of the links (a, b): connected components by alternating stars."""
    kept = Scratch(links.sparkSession)

    def stamp(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = kept.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while (now := stamp(e)) != before:
        before, hint = now, _hint(2 * now[0])
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(hint(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hint(low), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept.keep(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        kept.only(e)
    roots = e.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


def _enough(inter: Column, total: Column) -> Column:
    return 100 * inter >= PERCENT * (total - inter)


def _distance(inter: Column, total: Column) -> Column:
    return 1 - inter / (total - inter)


def _need(n: Column, x: Column) -> Column:
    """What the windows of a link of sizes n and x share, at least."""
    return PERCENT * (n + x) / (100 + PERCENT) - F.greatest(n, x) * PERCENT / 100


def _fits(n: Column, x: Column) -> Column:
    """Sets of these sizes can be linked."""
    return 100 * F.least(n, x) >= PERCENT * F.greatest(n, x)


def _reaches(after: Column, n: Column, x: Column) -> Column:
    """What a set of size n has from a window shingle on is enough for a link with a set of size x that first meets it there."""
    return after + _behind(n) >= PERCENT * (n + x) / (100 + PERCENT) - 1e-6


def _outer_regions(rows: DataFrame) -> DataFrame:
    """(r, key, n, after, own, least) for the sets of each outer region and size class; r is null on rows that only count for the degree.

    ``least`` is the degree that a link in the region takes. Only shingles that another set of a fitting size has are rows.
    """
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0).cast("int")).repartition("s", "salt")
    place, region = Window.partitionBy("s", "salt"), Window.partitionBy("s", "salt", "c").orderBy("n")
    whole = region.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = rows.withColumn("m", F.count(F.lit(1)).over(place)).where("m > 1 OR hot").drop("m").dropDuplicates(["s", "salt", "key"])
    base = base.withColumns({"below": F.lag("n").over(place.orderBy("n")), "above": F.lead("n").over(place.orderBy("n"))})
    meets = [F.col(x).isNotNull() & _fits(F.col("n"), F.col(x)) for x in ("below", "above")]
    base = base.where(F.col("hot") | meets[0] | meets[1])
    size_class = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / PERCENT) * (1 + 1e-9))).cast("int")
    classed = base.withColumn("class", size_class).withColumn("c", F.explode(F.array(F.col("class"), F.col("class") + 1))).withColumn("own", F.col("class") == F.col("c"))
    # the smallest and largest size that a set can meet: an own set meets all others, one of the class below the own ones
    first, last = F.row_number().over(region) == 1, F.lead("n").over(region).isNull()
    own_n = F.when(F.col("own"), F.col("n"))
    low = F.when(~F.col("own"), F.min(own_n).over(whole)).when(first, F.lead("n").over(region)).otherwise(F.min("n").over(whole))
    high = F.when(~F.col("own"), F.max(own_n).over(whole)).when(last, F.lag("n").over(region)).otherwise(F.max("n").over(whole))
    seen = classed.withColumns({"low": low, "high": high})
    n = F.col("n").cast("double")
    met = (F.col("low") <= n * 100 / PERCENT) & (F.col("high") >= n * PERCENT / 100)
    low, high = F.greatest(F.col("low").cast("double"), n * PERCENT / 100), F.least(F.col("high").cast("double"), n * 100 / PERCENT)
    need = F.least(_need(n, low), _need(n, high)) - 1e-6
    able = F.coalesce(met & (F.col("after") > need) & _reaches(F.col("after"), n, low), F.lit(False))
    # a region is named by its members; a chance meeting of names only joins two regions
    hashed = [F.bit_xor(F.when(F.col("able"), F.xxhash64("key", F.lit(i)))).over(whole) for i in (0, 1)]
    # a hot shingle's sets are in many tasks, none of which knows all sizes
    least = F.when(F.col("hot"), 1).otherwise(F.floor(need).cast("int") + 1)
    named = seen.withColumns({"able": able, "least": least}).withColumn("left", F.count(F.when(F.col("able"), 1)).over(whole))
    r = F.when(F.col("hot"), F.xxhash64("s", "c")).when(F.col("able") & (F.col("left") > 1), F.xxhash64(*hashed, "c"))
    return named.withColumn("r", r).where("own OR r IS NOT NULL").select("r", "key", "n", "after", "own", "least")


def _members(outer: DataFrame) -> DataFrame:
    """(r, key, after, n, own, degree, before) of the sets with degree enough, which is how many of their window shingles a set of a fitting size has.

    ``before`` is the set's region before this one. Sets with the same one meet there, so this is not the region of their first common shingle.
    """
    counted = outer.repartition("key").withColumn("degree", F.count(F.when(F.col("own"), 1)).over(Window.partitionBy("key")))
    able = counted.where("r IS NOT NULL AND degree >= least")
    # two sets of the class below do not meet in a region: each of a set's two classes has an order of its own
    able = able.withColumn("before", F.lag("r").over(Window.partitionBy("key", "own").orderBy(F.desc("after"))))
    first = F.max(F.struct("after", "before")).alias("first")
    out = able.groupBy("key", "r").agg(first, F.max("n").alias("n"), F.max("own").alias("own"), F.max("degree").alias("degree"))
    return out.select("r", "key", F.col("first.after").alias("after"), "n", "own", "degree", F.col("first.before").alias("before"))


def jaccard_links(df: DataFrame, scan: DataFrame, kept: Scratch, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) between set digests that connect all sets at distance 1/4 or less."""
    spark = df.sparkSession
    docs = scan.where("key IS NOT NULL")
    total = docs.agg(F.sum("n")).first()[0] or 0
    counts = scan.where("s IS NOT NULL").groupBy("s").agg(F.sum("c").alias("c"))
    found = counts.where(F.col("c") > max(MANY, total // MOST_FREQUENT)).toArrow()
    values, times = found["s"].to_numpy().astype(np.int64).view(np.uint64), found["c"].to_numpy().astype(np.float64)
    order = np.argsort(values)
    frequent = spark.sparkContext.broadcast((values[order], np.log2(np.maximum(times[order], 1)).astype(np.int8)))

    texts = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = texts.select("text").mapInArrow(_windows(frequent), "s long, key binary, n int, after int, hot boolean")
    members = kept.keep(_members(_outer_regions(rows)).withColumn("label", F.col("key")))
    members = kept.keep(_able(members, _hint(members.count())))
    kept.only(scan, members)
    able = sized(kept.keep(members.select("key").distinct()))
    sets = kept.keep(_named(docs.where("n > 0").join(able, "key", "left_semi")))
    size = sets.agg(F.coalesce(F.sum(64 + F.length("bits")), F.lit(0))).first()[0]
    sets = _Sets(sets, F.broadcast if size <= SMALL_BYTES else lambda df: df)
    pivots, turn, links, labels = 1, 0, [], None
    while not members.isEmpty():
        chosen = kept.keep(_pivots(members, pivots, turn))
        regions = chosen.count()  # a region has a pivot and at most a cell for each: so many rows by region or cell at most
        hint = _hint(regions)
        pairs = members.join(hint(chosen.select("r", F.struct("key", "n", "own", "label", "after", "degree", "before").alias("p"))), "r").where(_viable(F.col("p")))
        bounded = kept.keep(_bounded(pairs.select(F.greatest("key", "p.key").alias("a"), F.least("key", "p.key").alias("b")).distinct(), sets, kept))
        may = _enough(F.col("most"), F.col("an") + F.col("bn"))
        exact = _exact(bounded.where(may), texts, sets, kept)
        measured = kept.keep(bounded.where(~may).select("a", "b", "most", F.lit(False).alias("near")).union(exact))
        found = measured.where("near").count()
        if found:
            links.append(measured)
            labels = kept.keep(_labels(_linked(links, scan), _hint(2 * sum(x.where("near").count() for x in links))))
        relabel = _relabel(labels)
        rest = kept.keep(_able(relabel(members.join(hint(chosen.select("r", "key")), ["r", "key"], "left_anti")), hint))
        members = _cells(rest, relabel(chosen), measured, sets, kept, regions, found) if found else rest
        kept.only(scan, sets.table, labels, members, *links)
        pivots, turn = pivots * (PIVOTS_TIMES if turn == 0 else PIVOTS_TIMES**2), turn + 1
    return _linked(links, scan)


def _named(docs: DataFrame) -> DataFrame:
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"))


class _Sets(NamedTuple):
    """key, doc, n, bits of the sets that can have links, and how to join it."""

    table: DataFrame
    hint: Callable


def _linked(links: list[DataFrame], scan: DataFrame) -> DataFrame:
    """The links (a, b) among the pairs measured so far; none yet: no rows of ``scan``."""
    parts = [measured.where("near").select("a", "b") for measured in links]
    return reduce(DataFrame.union, parts) if parts else scan.where("false").select(F.col("key").alias("a"), F.col("key").alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def _bounded(pairs: DataFrame, sets: _Sets, kept: Scratch) -> DataFrame:
    """(a, b, an, bn, most): the pairs (a, b) with an upper bound of their common shingles by their bitmaps."""
    pairs = kept.keep(pairs)
    hint = _hint(pairs.count())
    of = lambda x: sets.hint(sets.table.join(hint(pairs.select(F.col(x).alias("key")).distinct()), "key", "left_semi"))  # noqa: E731  only what the pairs name is dealt out
    side = lambda x: of(x).select(F.col("key").alias(x), F.col("n").alias(x + "n"), F.col("bits").alias(x + "bits"))
    # few pairs go to where the sets b are; more meet them by a shuffle
    return side("b").join(hint(pairs), "b").join(side("a"), "a").mapInArrow(_bounds, "a binary, b binary, an long, bn long, most long")


def _exact(pairs: DataFrame, texts: DataFrame, sets: _Sets, kept: Scratch) -> DataFrame:
    """(a, b, most, near): the pairs with the size of their intersection, from their whole sets, and whether they are links."""
    sides = [F.struct(F.col(x).alias("key"), F.lit(x == "a").alias("is_a"), F.lit(x == "b").alias("is_b")) for x in "ab"]
    ends = pairs.select(F.explode(F.array(*sides)).alias("e")).groupBy("e.key").agg(F.max("e.is_a").alias("is_a"), F.max("e.is_b").alias("is_b"))
    wanted = kept.keep(ends.join(sets.hint(sets.table.select("key", "doc")), "key").select("doc", "key", "is_a", "is_b"))
    if wanted.isEmpty():
        return pairs.where("false").select("a", "b", "most", F.lit(False).alias("near"))
    wanted = sized(wanted)
    whole = texts.join(wanted, texts["id"].eqNullSafe(wanted["doc"])).select("text", "key", "is_a", "is_b")
    whole = kept.keep(whole.mapInArrow(_whole, "key binary, is_a boolean, is_b boolean, items array<long>"))
    size = whole.agg(F.coalesce(F.sum(64 + 8 * F.size("items")), F.lit(0))).first()[0]
    whole = F.broadcast(whole) if size <= SMALL_BYTES else whole
    side = lambda x: whole.where("is_" + x).select(F.col("key").alias(x), F.col("items").alias(x + "i"))  # noqa: E731  a set is dealt out as what it is in pairs
    both = side("b").join(_hint(pairs.count())(pairs.select("a", "b", "an", "bn")), "b").join(side("a"), "a")
    shared = both.select("a", "b", F.size(F.array_intersect("ai", "bi")).cast("long").alias("most"), (F.col("an") + F.col("bn")).alias("total"))
    return shared.select("a", "b", "most", _enough(F.col("most"), F.col("total")).alias("near")).distinct()  # repeated rows give a set twice


def _behind(n: Column) -> Column:
    """How many shingles a set of size n has behind its window."""
    return F.ceil(n * PERCENT / 100) - 1


def _able(members: DataFrame, hint: Callable) -> DataFrame:
    """Members that can have a link in their region by its labels and sizes and their own number of shared window shingles.

    A pair needs to meet only in the region of its first common shingle; what its windows share is then at or after it.
    A link of sizes n and x needs more than g(x) = 3/7 (n + x) - 3/4 max(n, x) shared ones. g rises up to n and falls
    from there, so the region's smallest and largest size (within the factor of a link) tell the least need.
    """
    n = F.col("n").cast("double")
    stats = members.groupBy("r").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("own").alias("owns"), F.min("n").alias("low"), F.max("n").alias("high"), (F.max("before").isNull() | (F.count("before") < F.count(F.lit(1))) | (F.min("before") != F.max("before"))).alias("first"))
    low = F.greatest(F.col("low").cast("double"), n * PERCENT / 100)
    high = F.least(F.col("high").cast("double"), n * 100 / PERCENT)
    live = members.join(hint(stats.where("owns AND l0 != l1 AND first").select("r", "low", "high")), "r")
    enough = F.least("after", "degree") > F.least(_need(n, low), _need(n, high)) - 1e-6
    return live.where(enough & _reaches(F.col("after"), n, low)).drop("low", "high")


def _pivots(members: DataFrame, count: int, turn: int) -> DataFrame:
    """Up to ``count`` sets of each region: the most central one of each of ``count`` slots, of components while there are few slots, then of sets."""
    # the fewer rare shingles a set has before the region's, the more central it is
    best = F.struct((~F.col("own")).alias("other"), (-F.col("after") / F.col("n")).alias("rare"), "key", "n", "own", "label", "after", "degree", "before")
    slot = F.pmod(F.xxhash64("label" if turn < 2 else "key", F.lit(turn)), F.lit(count))
    return members.groupBy("r", slot.alias("slot")).agg(F.min(best).alias("p")).select("r", *[F.col("p." + c) for c in ("key", "n", "own", "label", "after", "degree", "before")])


def _viable(p: Column) -> Column:
    """The pair is to be compared: other component, no common region before, sizes that can link, one of the region's own class, shared windows enough."""
    n, total = F.col("n"), F.col("n") + p["n"]
    fits = _fits(n, p["n"]) & _reaches(F.col("after"), n, p["n"]) & _reaches(p["after"], p["n"], n)
    return (F.col("key") != p["key"]) & (F.col("label") != p["label"]) & (F.col("own") | p["own"]) & ~F.coalesce(F.col("before") == p["before"], F.lit(False)) & fits & _enough(F.least(F.col("after"), p["after"], F.col("degree"), p["degree"]) + _behind(F.greatest(n, p["n"])), total)


def _labels(links: DataFrame, hint: Callable) -> DataFrame:
    """(a, b): for each linked set a set that it is connected with, the least one as far as a few links show. Equal labels are connected."""
    both = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")]
    ends = links.select(F.explode(F.array(*both)).alias("e")).select("e.a", "e.b")
    low = ends.groupBy("a").agg(F.min("b").alias("m"))
    low = ends.join(hint(low.toDF("b", "m")), "b").groupBy("a").agg(F.min("m").alias("m"))
    return low.join(hint(low.toDF("m", "b")), "m").select("a", "b").where("a != b")


MEMBER = ["r", "key", "n", "after", "degree", "own", "label", "before"]


def _relabel(labels: DataFrame | None):
    """A function that gives members the labels of what is linked."""
    if labels is None:
        return lambda x: x
    labels = sized(labels)
    return lambda x: x.join(labels, x["key"] == labels["a"], "left").withColumn("label", F.coalesce("b", "label")).select(*MEMBER)


def _cells(rest: DataFrame, chosen: DataFrame, measured: DataFrame, sets: _Sets, kept: Scratch, regions: int, found: int) -> DataFrame:
    """The regions ``rest`` after a round: Voronoi cells of the pivots that got links, with their triangle windows, and the sets without a home.

    There are at most ``regions`` rows by region or cell, and ``found`` links in this round.
    """
    hint = _hint(regions)
    ends = _ends(measured.where("near"))
    # HUBS pivots at most for each region: the nearest to the centre of each of HUBS slots
    hubs = _pivots(chosen.join(_hint(2 * found)(ends), "key", "left_semi"), HUBS, 0).select("r", F.col("key").alias("q"), F.col("n").alias("qn"), F.col("label").alias("qlabel"))
    beside = rest.join(hint(hubs), "r").withColumns({"a": F.greatest("key", "q"), "b": F.least("key", "q")})
    fits = 100 * F.least("n", "qn") >= (100 - 2 * (100 - PERCENT)) * F.greatest("n", "qn")
    beside = kept.keep(beside.where(fits | (F.col("label") == F.col("qlabel"))))
    if beside.isEmpty():
        return rest
    unknown = beside.where("label != qlabel").select("a", "b").distinct().join(measured, ["a", "b"], "left_anti")
    measured = measured.union(_bounded(unknown, sets, kept).select("a", "b", "most", F.lit(False).alias("near")))
    beside = kept.keep(beside.join(measured, ["a", "b"], "left").withColumn("d", _distance(F.col("most"), F.col("n") + F.col("qn"))))
    home = beside.where("near").groupBy("r", "key").agg(F.min(F.struct("d", "q")).alias("home"))
    home = kept.keep(home.select("r", "key", F.col("home.d").alias("d"), F.col("home.q").alias("q")))
    radius = home.groupBy("r", "q").agg(F.max("d").alias("radius"))
    reach = F.col("radius") + (100 - PERCENT) / 100 + 1e-9
    windows = beside.where("label != qlabel AND NOT near").join(hint(radius), ["r", "q"]).where(F.col("d") <= reach)
    windows = kept.keep(windows.select("q", *MEMBER))
    # a region whose cells would take more copies than it has sets stays whole
    copies = windows.groupBy("r").agg(F.count(F.lit(1)).alias("copies"))
    sizes = rest.groupBy("r").agg(F.count(F.lit(1)).alias("sets"))
    whole = hint(copies.join(hint(sizes), "r").where("copies > sets").select("r"))
    placed = rest.join(_hint(home.count())(home.select("r", "key", "q").join(whole, "r", "left_anti")), ["r", "key"], "left")
    cell = F.xxhash64("r", "q")
    stay = placed.withColumn("own", F.col("own") | F.col("q").isNotNull()).withColumn("r", F.when(F.col("q").isNull(), F.col("r")).otherwise(cell)).select(*MEMBER)
    guests = windows.join(whole, "r", "left_anti").withColumn("r", cell).withColumn("own", F.lit(False)).select(*MEMBER)
    return kept.keep(_able(stay.union(guests), _hint(2 * regions)))


def jaccard_sets(df: DataFrame, kept: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written first pass over ``df``."""
    ship(df.sparkSession)
    run, schema = _scan(df.schema[doc_id].dataType.simpleString())
    return kept.keep(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th")).mapInArrow(run, schema))


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; ``with_text_hash`` adds ``th``, xxhash64 of the text."""
    kept = Scratch(df.sparkSession)
    scan = jaccard_sets(df, kept, doc_id, text)
    roots = components(jaccard_links(df, scan, kept, doc_id, text))
    docs = scan.where("key IS NOT NULL").select("doc_id", "n", "key", "th")
    points = docs.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    rooted = points.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("key", "component_id")
    out = docs.where("n > 0").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "th")
    out = out.union(docs.where("n = 0").select("doc_id", "n", "doc_id", "th"))
    return out if with_text_hash else out.drop("th")


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one document, the one of the smallest id, of each component; rows without an id stay.

    What goes is named by id and text, so another text of the same id stays.
    """
    found = jaccard_components(df, doc_id, text, with_text_hash=True)
    go = found.where("doc_id != component_id").select(F.col("doc_id").alias(OWN + "id"), F.col("th").alias(OWN + "th")).distinct()
    go = sized(Scratch(df.sparkSession).keep(go))
    return df.join(go, (df[doc_id] == go[OWN + "id"]) & (F.xxhash64(df[text]) == go[OWN + "th"]), "left_anti")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def jaccard_ctes(source: str = "documents") -> str:
    """CTEs ending in ``comp``: doc_id, n_shingles, component_id. All pairs that share a shingle are counted."""
    return f"""
w7 AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {source}),
s7 AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS s
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS i FROM w7 WHERE len(ws) > 0)),
n7 AS (SELECT doc_id, count(*) AS n FROM s7 GROUP BY doc_id),
i7 AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s7 a JOIN s7 b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l7 AS (SELECT x, y FROM i7 JOIN n7 p ON p.doc_id = x JOIN n7 q ON q.doc_id = y WHERE 100 * i >= {PERCENT} * (p.n + q.n - i)),
r7 AS (SELECT doc_id AS x, doc_id AS y FROM n7 UNION SELECT r7.x, l7.y FROM r7 JOIN l7 ON r7.y = l7.x),
m7 AS (SELECT x, min(y) AS component_id FROM r7 GROUP BY x),
comp AS (SELECT w7.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w7.doc_id) AS component_id
         FROM w7 LEFT JOIN n7 USING (doc_id) LEFT JOIN m7 ON m7.x = w7.doc_id)"""


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLES = {"op7_jaccard_join": f"WITH RECURSIVE {jaccard_ctes()} SELECT * FROM comp"}

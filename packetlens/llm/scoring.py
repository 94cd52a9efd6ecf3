"""Language-model scoring by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing at every order: p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu), where h' is h without its
first word, down to p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). As an automaton: a state is the longest suffix of the words read
that training has seen, at most ORDER - 1 of them. A state has an arc for each word seen after it, with weight log10 p, and a failure arc to the state
without its first word, with weight log10 (mu / (c(h) + mu)). A word takes the failure arcs down to the first state that has an arc for it.
One pass from left to right reads a text, carries the state and adds up the weights.

The model grows with the corpus, so no task has it whole. Texts are dealt at random to groups of about 8 MB. A group asks for the counts of
the distinct n-grams of its texts: sorted 56-bit hashes, split by their high bits into buckets, with the group's own training counts. A bucket sums
the counts of each of its n-grams over all groups and answers each group in the order of its question, without the hashes.
So a word that is everywhere is one number a group. A group then has the part of the automaton that its texts can reach. Because
a state is the longest seen suffix, the states of all positions of a group's texts follow from the counts and are found side by side.
The texts are shuffled once, compressed, for both passes; a text beyond PIECE is scored in pieces, each after the last words of the one before.

Memory: a group and a bucket are bounded by their mean, as hashes are spread evenly; the most frequent n-grams add one number a group
to their bucket. 56 bits: with 10^11 distinct n-grams one in 10^6 shares its count with another.

Defined results: a null text is empty and consists of the end token. A null id is hashed as an empty text. Repeated rows count and are scored each
for itself. Without training texts N and V are 0 and every probability is 1. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

ORDER = 3
MU = 5.0
ALPHA = 0.1
FOLDS = 10
#: Bytes of text of a group, n-grams of a bucket, code points of a piece.
GROUP_BYTES, BUCKET_GRAMS, PIECE = 8 << 20, 1 << 20, 1 << 20
BITS = 56
END, NONE = np.uint64(0), np.uint64(2**64 - 1)
#: Positions that the automaton reads side by side.
TOGETHER = 1 << 17
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


# --- tokens and n-grams -------------------------------------------------------------------


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the lower-cased words of UTF-8 bytes; none is END."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    return np.maximum(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


def gram_hashes(words: np.ndarray, before: np.ndarray, order: int = ORDER) -> Iterator[np.ndarray]:
    """For each order in turn, the hash of the n-gram that ends at each position; ``before`` says how many words its text has before it. NONE where there are too few."""
    h = np.zeros_like(words)
    for n in range(order):
        # an n-gram is its last n - 1 words after the word before them
        h *= _A
        h[n:] += words[: len(words) - n]
        h += np.uint64(n + 1)
        h = _mixed(h)
        yield np.where(before >= n, h >> np.uint64(64 - BITS), NONE)


def pieces_of(text: str, size: int = PIECE, context: int = ORDER - 1) -> Iterator[tuple[str, str]]:
    """A text in pieces of about ``size`` code points that end where a word does, and the last words before each."""
    start, before = 0, ""
    while True:
        stop = min(len(text), start + size)
        while stop < len(text) and text[stop] not in " \t\n\v\f\r":
            stop += 1
        yield text[start:stop], before
        if stop >= len(text):
            return
        # the last words only: split from the end
        words = (before + " " + text[start:stop]).encode().rsplit(None, context) if context else []
        before, start = b" ".join(words[-context:]).decode(), stop


def _cut(size: int, context: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, doc, train, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = text.as_py() or ""
                whole = [(text, "")] if len(text) <= size else pieces_of(text, size, context)
                held = None
                for part, (piece, before) in enumerate(whole):
                    if held is not None:
                        rows.append((*held, False))
                    held = (own, doc, train, part, zlib.compress(piece.encode(), 1), before)
                rows.append((*held, True))
            if rows:
                own, doc, train, part, piece, before, last = zip(*rows, strict=True)
                docs = pa.array([d.as_py() for d in doc], batch.column(1).type)
                arrays = [pa.array(own, pa.int64()), docs, pa.array(train, pa.bool_()), pa.array(part, pa.int64()), pa.array(piece, pa.binary()), pa.array(before, pa.string()), pa.array(last, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["own", "doc_id", "train", "part", "piece", "before", "last"])

    return cut


class Texts:
    """The tokens of a group's pieces, one after the other, each after its context."""

    def __init__(self, rows: pa.Table, order: int):
        get = lambda n: rows.column(n).to_pylist()
        parts, sizes, contexts = [], [], []
        for piece, before, last in zip(get("piece"), get("before"), get("last"), strict=True):
            context = word_hashes(before.encode()) if before else np.zeros(0, np.uint64)
            words = word_hashes(zlib.decompress(piece))
            parts += [context, words] + [np.full(1, END, np.uint64)] * last
            sizes.append(len(context) + len(words) + last)
            contexts.append(len(context))
        self.words = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.sizes, self.contexts = np.array(sizes, np.int64), np.array(contexts, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.before = (np.arange(len(self.words)) - np.repeat(self.first, self.sizes)).astype(np.int32)
        #: positions that are the piece's own
        self.own = self.before >= np.repeat(self.contexts, self.sizes)
        self.train = np.repeat(np.array(get("train"), bool), self.sizes)
        self.order = order

    def grams(self) -> Iterator[np.ndarray]:
        return gram_hashes(self.words, self.before, self.order)

    def runs(self) -> Iterator[slice]:
        """Whole pieces together, about TOGETHER positions."""
        start = 0
        for stop in np.cumsum(self.sizes).tolist():
            if stop - start >= TOGETHER:
                yield slice(start, stop)
                start = stop
        yield slice(start, len(self.before))


#: Low bytes of wide numbers, which are as good as random, are kept as they are.
RANDOM_BYTES = 4


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest of all first, as many bytes as the largest needs; what can be compressed is."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = RANDOM_BYTES if width > RANDOM_BYTES else 0
    rows = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    head = bytes((width,)) + len(values).to_bytes(8, "little")
    return b"".join((head, rows[:, :raw].T.tobytes(), zlib.compress(rows[:, raw:width].T.tobytes(), 1)))


def from_planes(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    raw = RANDOM_BYTES if width > RANDOM_BYTES else 0
    out = np.zeros((n, 8), np.uint8)
    out[:, :raw] = np.frombuffer(data, np.uint8, n * raw, 9).reshape(raw, n).T
    out[:, raw:width] = np.frombuffer(zlib.decompress(memoryview(data)[9 + n * raw :]), np.uint8).reshape(width - raw, n).T
    return out.view("<u8").reshape(-1)


def _asker(order: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """A group's texts -> its distinct n-grams by bucket, with its training counts."""

    def ask(rows: pa.Table) -> pa.Table:
        texts = Texts(rows, order)
        group = rows.column("g")[0].as_py()
        out = []
        for n, grams in enumerate(texts.grams(), 1):
            # a piece's context is asked for, since states need its counts, but counted where it is a piece's own
            counted = texts.own & texts.train
            some = grams != NONE
            keys = np.sort((grams[some] << np.uint64(1)) | ~counted[some])
            gram = keys >> np.uint64(1)
            new = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
            counts = np.add.reduceat(1 - (keys & np.uint64(1)).astype(np.int64), new) if len(new) else new
            gram = gram[new]
            ends = np.searchsorted(gram, (np.arange(1, (1 << bits) + 1, dtype=np.uint64) << np.uint64(BITS - bits)) - np.uint64(1), "right")
            start = 0
            for bucket, stop in enumerate(ends.tolist()):
                if stop > start:
                    base = np.uint64(bucket << (BITS - bits))
                    out.append((bucket, group, n, planes(np.diff(gram[start:stop], prepend=base)), planes(counts[start:stop])))
                start = stop
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "g", "n", "grams", "counts"])

    return ask


def _answer(rows: pa.Table) -> pa.Table:
    """A bucket's n-grams of all groups -> their training counts over all groups, for each group in its order."""
    out, bucket = [], rows.column("bucket")[0].as_py()
    orders = np.asarray(rows.column("n"))
    tokens = kinds = 0
    for n in np.unique(orders).tolist():
        some = rows.filter(pa.array(orders == n))
        grams = [np.cumsum(from_planes(x)) for x in some.column("grams").to_pylist()]
        counts = np.concatenate([from_planes(x) for x in some.column("counts").to_pylist()]).astype(np.int64)
        distinct, where = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, where, counts)
        if n == 1:
            tokens, kinds = int(total.sum()), int((total > 0).sum())
        ends = np.cumsum([len(g) for g in grams])
        for group, answer in zip(some.column("g").to_pylist(), np.split(total[where], ends[:-1]), strict=True):
            out.append((group, n, bucket, planes(answer), tokens, kinds))
            tokens = kinds = 0  # once a bucket
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["g", "n", "bucket", "counts", "tokens", "kinds"])


# --- the automaton ------------------------------------------------------------------------


def arc_weights(counts: list[np.ndarray], before: np.ndarray, total: int, kinds: int, mu: float = MU) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """At each position, the weights of the arcs by which its word can be read, and of the failure arcs of the state before, for states of 0, 1, ... words."""
    p = (counts[0] + ALPHA) / (total + ALPHA * (kinds + 1))
    arcs, failures = [np.log10(p)], [np.zeros(len(p))]
    for n in range(1, len(counts)):
        # the state of n words before this position, where there is one
        history = np.where(before >= n, np.concatenate([[0], counts[n - 1][:-1]]), 0)
        p = (counts[n] + mu * p) / (history + mu)
        arcs.append(np.log10(p))
        failures.append(np.log10(mu / (history + mu)))
    return arcs, failures


def traverse(counts: list[np.ndarray], before: np.ndarray, total: int, kinds: int, mu: float = MU) -> np.ndarray:
    """The weight with which the automaton reads the word at each position, in the state that the words before led to."""
    arcs, failures = arc_weights(counts, before, total, kinds, mu)
    order = len(counts)
    # the state after a position: how many of the last words are seen together
    state = np.zeros(len(before), np.int64)
    for n in range(1, order):
        state = np.where((before >= n - 1) & (counts[n - 1] > 0), n, state)
    state = np.where(before > 0, np.concatenate([[0], state[:-1]]), 0)
    weight, at = np.zeros(len(before)), state
    reading = np.ones(len(before), bool)
    for n in range(order - 1, -1, -1):
        here = reading & (at == n)
        takes = here & ((counts[n] > 0) | (n == 0))  # the empty state has an arc for every word
        weight = np.where(takes, weight + arcs[n], np.where(here, weight + failures[n], weight))
        reading &= ~takes
        at = np.where(here & ~takes, n - 1, at)
    return weight


def _scorer(order: int, mu: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The counts that a group asked for, and its texts -> its scores."""

    def score(answers: pa.Table, rows: pa.Table) -> pa.Table:
        texts = Texts(rows, order)
        answers = answers.sort_by([("n", "ascending"), ("bucket", "ascending")])
        total, kinds = answers.column("total")[0].as_py(), answers.column("distinct")[0].as_py()
        orders, counts = np.asarray(answers.column("n")), []
        for n, grams in enumerate(texts.grams(), 1):
            found = [from_planes(x) for x in answers.filter(pa.array(orders == n)).column("counts").to_pylist()]
            some = grams != NONE
            here = np.zeros(len(grams), np.int64)
            here[some] = np.concatenate([*found, np.zeros(0, np.uint64)]).astype(np.int64)[np.unique(grams[some], return_inverse=True)[1]]
            counts.append(here)
        texts.words = None
        weight = np.concatenate([traverse([c[run] for c in counts], texts.before[run], total, kinds, mu) for run in texts.runs()])
        weight[~texts.own] = 0
        base = np.log10((counts[0] + ALPHA) / (total + ALPHA * (kinds + 1)))
        base[~texts.own] = 0
        # a piece that is not the last may be all white space and have no position of its own
        ends = np.cumsum(texts.sizes)
        sums = [np.array([x[a:b].sum() for a, b in zip((ends - texts.sizes).tolist(), ends.tolist(), strict=True)]) for x in (base, weight)]
        per = lambda x: np.concatenate([[0], np.cumsum(x)])
        count = lambda x: per(x)[ends] - per(x)[ends - texts.sizes]
        columns = [rows.column("own"), rows.column("doc_id"), rows.column("train"), rows.column("part"), pa.array(count(texts.own)), pa.array(count(texts.own & (counts[0] > 0)))]
        columns += [pa.array(np.full(len(ends), total, np.int64)), pa.array(sums[0], pa.float64()), pa.array(sums[1], pa.float64())]
        return pa.Table.from_arrays(columns, ["own", "doc_id", "train", "part", "n_tokens", "n_known", "train_tokens", "base", "score"])

    return score


def lm_scores(df: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, mu: float = MU, group_bytes: int = GROUP_BYTES, piece: int = PIECE, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``df``."""
    spark = df.sparkSession
    ship(spark)
    name = df.schema[doc_id].dataType.simpleString()
    size = df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    groups = size // group_bytes + 1
    # a byte of text brings at most about half an n-gram that its group does not have yet
    bits = max(0, (size // 2 // bucket_grams).bit_length())
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS
    rows = df.select(F.monotonically_increasing_id().alias("own"), F.col(doc_id).alias("doc_id"), (fold != 0).alias("train"), F.col(text).alias("text"))
    cut = rows.mapInArrow(_cut(piece, order - 1), f"own long, doc_id {name}, train boolean, part long, piece binary, before string, last boolean")
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("own", "part"), F.lit(groups)))
    asked = dealt.groupBy("g").applyInArrow(_asker(order, bits), "bucket long, g long, n int, grams binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "g long, n int, bucket long, counts binary, tokens long, kinds long")
    corpus = answers.agg(F.struct(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("distinct"))).scalar()
    answers = answers.select("g", "n", "bucket", "counts", corpus.alias("corpus")).select("g", "n", "bucket", "counts", "corpus.*")
    scored = answers.groupBy("g").cogroup(dealt.groupBy("g")).applyInArrow(
        _scorer(order, mu), f"own long, doc_id {name}, train boolean, part long, n_tokens long, n_known long, train_tokens long, base double, score double"
    )
    parts = F.array_sort(F.collect_list(F.struct("part", "base", "score")))
    summed = lambda c: F.aggregate("parts", F.lit(0.0), lambda a, x: a + x[c])
    whole_rows = scored.groupBy("own").agg(*[F.first(c).alias(c) for c in ("doc_id", "train", "train_tokens")], F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), parts.alias("parts"))
    return whole_rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", summed("base").alias("base_score"), summed("score").alias("score"))


def op11_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op11_lm_scoring": op11_lm_scoring}
ORACLES: dict[str, str] = {}

"""Fill-in-middle transformation by a parallel automaton scan.

Tokens are runs of white space with the word after them, and white space at the end. A document is cut at two token
borders into prefix, middle and suffix, which the output puts in another order behind control strings. The borders come from two automata:
one ticks where a word ends, one finds control strings. The transition functions of an automaton are a small monoid, so a run of
symbols, a chunk or a document is one element of it and a tick count for each entry state, and two neighbours join by one table look-up.

* Within a chunk (65536 code points) symbols join pairwise up a tree, all chunks of a batch side by side.
* A document of one chunk is cut where it is read: a narrow map. Chunks of longer documents become a table that
  is dealt by chunk. Their functions are composed in blocks of 128 chunks, the blocks over the document; that gives the
  token count and the state and ticks with which each block is entered. A cut goes down the same way: to the
  block that has its tick, to the chunk, and only that chunk is searched. No task holds a document's text.
* ``infill`` returns the output in pieces in order (``ord``, ``at``): one row for a short document, for longer ones a row for
  each control string and each part of a chunk. ``infill_digests`` reads these back as a stream; a digest is
  sequential by definition, so a document is one task's stream there, which holds one piece at a time and sorts with spilling.

Defined results: a null text is empty; a null id is hashed as the seed alone. Rows with the same id, or wholly repeated ones, are
transformed each for itself, alike. Empty texts and texts that contain a control string stay plain. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, sized, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
#: Code points of a chunk, and chunks of a block.
CHUNK, FAN = 1 << 16, 128
#: Code points that are scanned side by side.
TOGETHER = 1 << 20
LEAF = 16


class Automaton:
    """A finite automaton over symbol classes, as its transition monoid.

    ``steps[c][s]`` is the state after class ``c`` in state ``s``, ``ticks[c][s]`` what that counts. Element 0 is the identity,
    ``product[a, b]`` is a and then b, ``after[a, s]`` the state that ``a`` leads to from ``s``.
    """

    def __init__(self, classes: dict[str, int], steps: list[tuple[int, ...]], ticks: list[tuple[int, ...]] | None = None):
        self.states = len(steps[0])
        found = {tuple(range(self.states)): 0}
        for step in steps:
            found.setdefault(step, len(found))
        grown = True
        while grown:
            some = list(found)
            for a in some:
                for b in steps:
                    found.setdefault(tuple(b[s] for s in a), len(found))
            grown = len(found) > len(some)
        elements = list(found)
        self.after = np.array(elements, np.intp)
        self.product = np.array([[found[tuple(b[s] for s in a)] for b in elements] for a in elements], np.uint8)
        self.of_class = np.array([found[s] for s in steps], np.uint8)
        self.ticks = np.array(ticks, np.int32) if ticks else None
        # the last entry stands for all code points from 255 on
        self.class_of = np.zeros(256, np.uint8)
        for chars, c in classes.items():
            for char in chars:
                self.class_of[ord(char)] = c

    def classes(self, codes: np.ndarray) -> np.ndarray:
        return self.class_of[np.minimum(codes, 255)]

    def _join(self, f: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        left, right = f[0::2], f[1::2]
        if n is not None:
            n = n[0::2] + np.take_along_axis(n[1::2], self.after[left], axis=1)
        return self.product[left, right], n

    def scan(self, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The monoid element of each run of symbols, and its ticks from each entry state; ``lengths`` are those of the runs."""
        f, n = self.of_class[classes], None if self.ticks is None else self.ticks[classes]
        step = LEAF
        while True:
            padded = np.maximum(step, -(-lengths // step) * step)
            at = np.repeat(np.cumsum(padded) - padded - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(f))
            even = np.zeros(int(padded.sum()), np.uint8)
            even[at] = f
            if n is not None:
                wide = np.zeros((len(even), self.states), np.int32)
                wide[at] = n
                n = wide
            f = even
            for _ in range(step.bit_length() - 1):
                f, n = self._join(f, n)
            lengths = padded // step
            if not len(lengths) or lengths.max() == 1:
                return f, n
            step = 2


SPACES = "\t\n\v\f\r "
GAP, WORD = 0, 1
#: Ticks where a word ends before white space.
TOKENS = Automaton({SPACES: 1}, [(WORD, WORD), (GAP, GAP)], [(0, 0), (0, 1)])
FOUND = 3
#: Ends in state FOUND once a control string was seen.
CONTROLS = Automaton({"<": 1, "PSM": 2, ">": 3}, [(0, 0, 0, FOUND), (1, 1, 1, FOUND), (0, 2, 0, FOUND), (0, 0, FOUND, FOUND)])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def tick_offset(classes: np.ndarray, state: int, rank: int) -> int:
    """Where the ``rank``-th tick (from 1) of a run of token classes is, entered in ``state``: how many symbols are before it."""
    space = classes == 1
    before = np.empty_like(space)
    before[1:], before[:1] = space[:-1], state == GAP
    return int(np.flatnonzero(space & ~before)[rank - 1])


def token_count(ticks: int, chars: int) -> int:
    """A tick ends every token but the last."""
    return ticks + (chars > 0)


def choose(digest: str, n: int, chars: int, marked: bool) -> tuple[str, int, int]:
    """Form and the two cuts, in tokens, from a document's digest."""
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not chars or marked or h[2] % 100 >= FIM_PERCENT:
        return "plain", 0, 0
    cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return ("spm" if h[3] % 100 < SPM_PERCENT else "psm"), *cuts


def arrange(form: str, prefix: str, middle: str, suffix: str) -> str:
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


COLUMNS = ["own_row", "doc_id", "n", "form", "prefix_chars", "middle_chars", "ord", "at", "output"]


def _schema(kind: str) -> str:
    return f"own_row long, doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, ord int, at long, output string"


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about TOGETHER code points."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > TOGETHER:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _scanned(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Token classes of each text, its token function and ticks, and its function for control strings."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = codes_of("".join(texts))
    classes = TOKENS.classes(codes)
    f, n = TOKENS.scan(classes, lengths)
    g, _ = CONTROLS.scan(CONTROLS.classes(codes), lengths)
    return np.split(classes, np.cumsum(lengths)[:-1]), f, n, g


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one chunk -> their outputs."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        digests = batch.column(2).to_pylist()
        rows = []
        for start, stop in _slices(texts):
            some = texts[start:stop]
            classes, _, ticks, g = _scanned(some)
            marked = CONTROLS.after[g, 0] == FOUND
            for text, c, t, m, digest in zip(some, classes, ticks[:, GAP], marked, digests[start:stop], strict=True):
                n = token_count(int(t), len(text))
                form, a, b = choose(digest, n, len(text), bool(m))
                if form == "plain":
                    rows.append((n, form, None, None, text))
                    continue
                p, q = (0 if k == 0 else len(text) if k == n else tick_offset(c, GAP, k) for k in (a, b))
                rows.append((n, form, p, q - p, arrange(form, text[:p], text[p:q], text[q:])))
        n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [[]] * 5
        none = pa.nulls(len(rows), pa.int64())
        columns = [none, batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
        columns += [pa.array(np.zeros(len(rows), np.int32)), pa.array(np.zeros(len(rows), np.int64)), pa.array(output, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, COLUMNS)


# --- documents of several chunks ----------------------------------------------------------


def _cutter(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, doc, text, digest in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                text = text.as_py()
                for first in range(0, len(text), size * FAN):
                    parts = [text[i : i + size] for i in range(first, min(len(text), first + size * FAN), size)]
                    n, part = len(parts), first // size
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(own, n), pa.repeat(doc, n), pa.repeat(digest, n), pa.array(range(part, part + n), pa.int64()), pa.array(parts, pa.string())],
                        ["own_row", "doc_id", "digest", "part", "chunk"],
                    )

    return cut


FUNCTION = "chars long, ends array<int>, ticks array<long>, controls array<int>"


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks -> their transition functions and tick counts."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for start, stop in _slices(texts):
            _, f, n, g = _scanned(texts[start:stop])
            lists = [TOKENS.after[f].tolist(), n.astype(np.int64).tolist(), CONTROLS.after[g].tolist()]
            arrays = [pa.array(x, pa.list_(t)) for x, t in zip(lists, (pa.int32(), pa.int64(), pa.int32()), strict=True)]
            chars = pa.array([len(t) for t in texts[start:stop]], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.slice(start, stop - start) for c in batch.columns[:2]], chars, *arrays], ["own_row", "part", "chars", "ends", "ticks", "controls"])


IDENTITY = "named_struct('chars', 0L, 'ends', array(0, 1), 'ticks', array(0L, 0L), 'controls', array(0, 1, 2, 3))"
#: ``a`` and then ``x``.
COMPOSED = """named_struct('chars', a.chars + x.chars, 'ends', transform(a.ends, s -> x.ends[s]),
    'ticks', zip_with(a.ticks, a.ends, (t, s) -> t + x.ticks[s]), 'controls', transform(a.controls, s -> x.controls[s]))"""
#: The entries of the functions in a list: state and ticks before each of them.
ENTERED = """reduce(list, named_struct('state', {state}, 'ticks', {ticks}, 'out', cast(array() AS array<struct<id:bigint,state:int,before:bigint,ticks:bigint>>)),
    (a, x) -> named_struct('state', x.ends[a.state], 'ticks', a.ticks + x.ticks[a.state],
        'out', concat(a.out, array(named_struct('id', x.id, 'state', a.state, 'before', a.ticks, 'ticks', x.ticks[a.state]))))).out"""


def _lists(functions: DataFrame, at: str, *keys: str) -> DataFrame:
    """The functions of each group in order, as one list."""
    return functions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("id"), "chars", "ends", "ticks", "controls"))).alias("list"))


def _composed(lists: DataFrame) -> DataFrame:
    return lists.withColumn("f", F.expr(f"reduce(list, {IDENTITY}, (a, x) -> {COMPOSED})"))


def _group_of(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the state they are entered in and the tick that is looked for -> its offset in the document."""
    for batch in batches:
        get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: B023, E731
        found = [start + tick_offset(TOKENS.classes(codes_of(text)), state, rank) for text, state, rank, start in zip(get("chunk"), get("state"), get("rank"), get("start"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["own_row", "cut", "offset"])


def cut_documents(chunks: DataFrame, size: int) -> DataFrame:
    """One row a document of ``chunks`` (own_row, doc_id, digest, part, chunk; each but the last with ``size`` code points): n, chars, form, and the offsets ``a`` and ``b`` of its cuts."""
    functions = Scratch(chunks.sparkSession).keep(chunks.select("own_row", "part", "chunk").mapInArrow(_functions, f"own_row long, part long, {FUNCTION}"))
    block = F.expr(f"part div {FAN}").alias("block")
    in_blocks = _lists(functions.select("own_row", "part", block, "chars", "ends", "ticks", "controls"), "part", "own_row", "block")
    blocks = _composed(in_blocks).select("own_row", "block", "f.*")
    whole = _composed(_lists(blocks, "block", "own_row"))
    entered = whole.select("own_row", F.col("f.chars").alias("chars"), F.expr("f.ticks[0] + cast(f.chars > 0 AS long)").alias("n"), F.expr(f"f.controls[0] = {FOUND}").alias("marked"),
                           F.expr(ENTERED.format(state=GAP, ticks="0L")).alias("blocks"))
    names = chunks.where("part = 0").select("own_row", "doc_id", "digest")
    h = [_group_of(F.col("digest"), i) for i in range(4)]
    plain = F.col("marked") | (F.col("chars") == 0) | (h[2] % 100 >= FIM_PERCENT)
    k1, k2 = (x % (F.col("n") + 1) for x in h[:2])
    plan = entered.join(names, "own_row").select(
        "own_row", "doc_id", "n", "chars", "blocks", F.when(plain, "plain").when(h[3] % 100 < SPM_PERCENT, "spm").otherwise("psm").alias("form"), F.array(F.least(k1, k2), F.greatest(k1, k2)).alias("cuts")
    )
    asked = plan.where("form != 'plain'").select("own_row", "n", "chars", "blocks", F.posexplode("cuts").alias("cut", "k"))
    sought = asked.where("k > 0 AND k < n").select("own_row", "cut", "k", F.expr("filter(blocks, b -> b.before < k AND k <= b.before + b.ticks)[0]").alias("b"))
    sought = sought.select("own_row", "cut", "k", F.col("b.id").alias("block"), F.col("b.state").alias("state"), F.col("b.before").alias("before"))
    # down into the block that has the tick, then into the chunk
    inside = sought.join(in_blocks, ["own_row", "block"]).select("own_row", "cut", "k", F.expr(ENTERED.format(state="state", ticks="before")).alias("chunks"))
    inside = inside.select("own_row", "cut", "k", F.expr("filter(chunks, c -> c.before < k AND k <= c.before + c.ticks)[0]").alias("c"))
    inside = inside.select("own_row", "cut", F.col("c.id").alias("part"), F.col("c.state").alias("state"), (F.col("k") - F.col("c.before")).alias("rank"))
    hits = inside.join(chunks.select("own_row", "part", "chunk"), ["own_row", "part"]).select("own_row", "cut", (F.col("part") * size).alias("start"), "state", "rank", "chunk")
    found = hits.mapInArrow(_searched, "own_row long, cut int, offset long")
    ends = asked.where("k = 0 OR k = n").select("own_row", "cut", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("chars")).cast("long").alias("offset"))
    offsets = ends.unionByName(found).groupBy("own_row").agg(F.min("offset").alias("a"), F.max("offset").alias("b"))
    return plan.select("own_row", "doc_id", "n", "chars", "form").join(offsets, "own_row", "left")


def _arranged(chunks: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """The parts of the chunks and the control strings, in the output's order."""
    prefix, middle = F.when(F.col("form") != "plain", F.col("a")), F.when(F.col("form") != "plain", F.col("b") - F.col("a"))
    about = [F.col("own_row"), F.col("doc_id"), F.col("n"), F.col("form"), prefix.alias("prefix_chars"), middle.alias("middle_chars")]
    spm = F.col("form") == "spm"
    rank = {PREFIX: F.when(spm, 1).otherwise(0), SUFFIX: F.when(spm, 0).otherwise(1), MIDDLE: F.lit(2)}
    strings = F.explode(F.array(*[F.struct(r.alias("ord"), F.lit(s).alias("output")) for s, r in rank.items()])).alias("s")
    heads = plan.where("form != 'plain'").select(*about, strings).select(*COLUMNS[:6], "s.ord", F.lit(-1).cast("long").alias("at"), "s.output")
    start = F.col("part") * size
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))

    def part(kind: str, low: Column, high: Column) -> Column:
        first = F.greatest(low - start, F.lit(0))
        text = F.col("chunk").substr((first + 1).cast("int"), F.greatest(high - start - first, F.lit(0)).cast("int"))
        return F.struct(rank[kind].alias("ord"), (start + first).alias("at"), text.alias("output"))

    end = start + size
    parts = F.array(part(PREFIX, F.lit(0), F.least(a, end)), part(MIDDLE, a, F.least(b, end)), part(SUFFIX, b, end))
    plain = F.array(F.struct(F.lit(0).alias("ord"), start.alias("at"), F.col("chunk").alias("output")))
    joined = chunks.select("own_row", "part", "chunk").join(sized(plan), "own_row")
    pieces = joined.select(*about, F.explode(F.filter(F.when(F.col("form") == "plain", plain).otherwise(parts), lambda p: p["output"] != "")).alias("s"))
    return heads.unionByName(pieces.select(*COLUMNS[:6], "s.ord", "s.at", "s.output"))


def infill_parts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The outputs of short rows and the output pieces of long ones, with the columns of ``infill``."""
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[doc_id].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256).alias("digest")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), digest)
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~long).mapInArrow(_short, _schema(kind))
    own = rows.where(long).select(F.monotonically_increasing_id().alias("own_row"), "doc_id", "text", "digest")
    dealt = own.mapInArrow(_cutter(chunk), f"own_row long, doc_id {kind}, digest string, part long, chunk string").repartition("own_row", "part")
    chunks = Scratch(spark).keep(dealt)
    plan = Scratch(spark).keep(cut_documents(chunks, chunk))
    return short, _arranged(chunks, plan, chunk)


def infill(df: DataFrame, **how) -> DataFrame:
    """Output pieces of every row: own_row (null where one piece is all), doc_id, n, form, prefix_chars, middle_chars, ord, at, output. Options as in ``infill_parts``."""
    short, long = infill_parts(df, **how)
    return short.unionByName(long)


# --- reading back -------------------------------------------------------------------------


def restore(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    suffix, prefix = head[len(SUFFIX) :].split(PREFIX) if form == "spm" else reversed(head[len(PREFIX) :].split(SUFFIX))
    return prefix + middle + suffix


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form, output = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        hashes = [[_sha(o) for o in output], [_sha(restore(o, f)) for o, f in zip(output, form, strict=True)]]
        # a plain text is its own output; the field order is that of the query
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(h, pa.string()) for h in hashes]], ["doc_id", "n", "prefix_chars", "middle_chars", "form", "output_sha256", "restored_sha256"])


#: Where the parts of an output belong in the text; 0 is the output itself.
PLACE = {PREFIX: 1, MIDDLE: 2, SUFFIX: 3}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outputs in pieces, in order -> the same as place 0 and, found by the control strings, the text's parts by place.

    Control strings may lie across pieces, so up to two characters are held back.
    """
    now, place, seq, held = None, 0, 0, ""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string()]

    for batch in batches:
        out: list[tuple] = []
        for own, form, output in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if own != now:
                if held:
                    out.append((now, place, seq, held))
                now, place, seq, held = own, PLACE[PREFIX], 0, ""
            seq += 1
            out.append((own, 0, seq, output))
            if form == "plain":
                out.append((own, place, seq, output))
                continue
            rest = held + output
            while True:
                at, mark = min(((rest.find(m), m) for m in PLACE if m in rest), default=(-1, ""))
                if at < 0:
                    break
                if at:
                    out.append((own, place, seq, rest[:at]))
                place, rest, seq = PLACE[mark], rest[at + len(mark) :], seq + 1
            keep = 2 if rest[-2:-1] == "<" else 1 if rest[-1:] == "<" else 0
            held = rest[len(rest) - keep :]
            if len(rest) > keep:
                out.append((own, place, seq, rest[: len(rest) - keep]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["own_row", "place", "seq", "piece"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, place, seq + 1, held), types, strict=True)], ["own_row", "place", "seq", "piece"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by document, place and sequence -> the two digests of each document."""
    now, hashes, out = None, (), []

    def close() -> None:
        if now is not None:
            out.append((now, hashes[0].hexdigest(), hashes[1].hexdigest()))

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["own_row", "output_sha256", "restored_sha256"])

    for batch in batches:
        for own, place, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if own != now:
                close()
                now, hashes = own, (hashlib.sha256(), hashlib.sha256())
            hashes[place > 0].update(piece.encode())
        if len(out) > 1000:
            yield rows()
            out.clear()
    close()
    if out:
        yield rows()


def infill_digests(short: DataFrame, long: DataFrame) -> DataFrame:
    """doc_id, n, prefix_chars, middle_chars, form, and the digests of the output and of the text restored from it, of what ``infill_parts`` returns."""
    kind = short.schema["doc_id"].dataType.simpleString()
    whole = short.select("doc_id", "n", "prefix_chars", "middle_chars", "form", "output")
    whole = whole.mapInArrow(_digests, f"doc_id {kind}, n long, prefix_chars long, middle_chars long, form string, output_sha256 string, restored_sha256 string")
    about = long.groupBy("own_row").agg(*[F.first(c).alias(c) for c in COLUMNS[1:6]])
    stream = long.select("own_row", "form", "output", "ord", "at").repartition("own_row").sortWithinPartitions("own_row", "ord", "at").select("own_row", "form", "output")
    parts = stream.mapInArrow(_parsed, "own_row long, place int, seq long, piece string").sortWithinPartitions("own_row", "place", "seq")
    hashed = parts.mapInArrow(_streamed, "own_row long, output_sha256 string, restored_sha256 string")
    return whole.unionByName(about.join(hashed, "own_row").drop("own_row"))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = infill_digests(*infill_parts(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def infill_sql() -> str:
    """DuckDB SQL: tokens as lists, cut by list slices."""
    h = lambda i: f"CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
                  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tokens FROM documents),
k AS (SELECT *, len(tokens) AS n, least({h(0)} % (len(tokens) + 1), {h(1)} % (len(tokens) + 1)) AS k1, greatest({h(0)} % (len(tokens) + 1), {h(1)} % (len(tokens) + 1)) AS k2,
             CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {h(2)} % 100 >= {FIM_PERCENT} THEN 'plain'
                  WHEN {h(3)} % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(list_slice(tokens, 1, k1), '') AS prefix, array_to_string(list_slice(tokens, k1 + 1, k2), '') AS middle, array_to_string(list_slice(tokens, k2 + 1, n), '') AS suffix FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle
                   ELSE '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM p"""


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": infill_sql()}

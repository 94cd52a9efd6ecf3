"""Byte-level BPE as a monoid tree reduction.

An element is the encoding of a byte string; the product of two neighbours is the encoding of their
concatenation. Facts used (merges always take the lowest rank, leftmost first):

* a token sequence is the encoding of its bytes if and only if every two adjacent tokens, encoded
  alone, come out as these two tokens (such a pair is *stable*): merges inside a token do not depend on its
  neighbours as long as nothing merges across its ends, and the first merge across an end would happen
  in the pair alone as well;
* so a product only has to look at the seam. If the seam's pair is stable, it is concatenation; else a
  window around the seam is encoded anew, doubled on each side whose outer pair is unstable, until both are
  stable. Then every adjacent pair is stable and the result is the encoding.

A text is cut by the pattern first, over the whole text, and merges never cross such a cut: there the
product is plain concatenation. Each piece is halved down to ``LEAF`` bytes and joined upwards, so a piece of a
million bytes costs O(n log^2 n) and no merge loop sees more than a window. Pieces, leaves and seams (pairs with the
encoding of their bytes, which is the first window) are memoised in bounded tables for each worker. Decoding maps leaves of
ids to bytes, a gather from the vocabulary, and concatenates up the tree; a text's bytes are a span of its batch's.

Distribution: a narrow map over Arrow batches, no shuffle; lost tasks are simply run again.

The pattern's letter, number and space classes are the tokenizer library's own, asked of it once: the regular-expression modules here
know other editions of Unicode. Latin-1 texts are cut by Python's own module, which is faster on small classes, if the pattern has only literals,
classes, repeats and lookaheads; other texts without a character on which the editions differ take the pattern as it is.

Defined results: a null text is an empty one (no ids, no bytes). Rows are independent, so repeated rows
and clashing ids do no harm; only the id and the text are read.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

LEAF = 4
SMALL = 48
PIECES_AT_ONCE = 1 << 18
#: Entries of a worker's tables: pieces of at most 64 characters (two generations), windows of at most 48 bytes, seams; 100 MB together.
CACHED_PIECES = 150_000
CACHED_STEPS = 50_000
CACHED_SEAMS = 150_000
DECODE_LEAF = 1 << 16
OUT_BYTES = 4 << 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: base64 token, space, rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def _ranges(points: list[int]) -> str:
    """Sorted code points as the inside of a character class."""
    out, start = [], 0
    for i in range(1, len(points) + 1):
        if i == len(points) or points[i] != points[i - 1] + 1:
            out.append(f"\\U{points[start]:08x}-\\U{points[i - 1]:08x}")
            start = i
    return "".join(out)


def library_pattern(pattern: str) -> tuple[str, str]:
    r"""The pattern with \p{L} and \p{N} spelled out as the tokenizer library has them, and a class of the characters that make a difference (or "")."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    spelled, differ = {}, set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        if kind in pattern.replace(r"\S", r"\s"):
            one = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            theirs = set(map(ord, one.decode(one.encode_ordinary(every))))
            differ |= theirs ^ set(map(ord, regex.findall(kind, every)))
            spelled[kind] = _ranges(sorted(theirs))
    out, at, inside = [], 0, False
    while at < len(pattern):
        if pattern[at] == "\\":
            kind = pattern[at : at + 5] if pattern.startswith("\\p{", at) else pattern[at : at + 2]
            if kind in spelled:
                out.append(spelled[kind] if inside else f"[{spelled[kind]}]")
            elif kind == r"\S" and not inside:
                out.append(f"[^{spelled[r'\s']}]")
            else:
                kind = pattern[at : at + 2]
                out.append(kind)
            at += len(kind)
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    return "".join(out), f"[{_ranges(sorted(differ))}]" if differ else ""


def latin_pattern(exact: str) -> re.Pattern | None:
    """A pattern with spelled classes for Latin-1 texts on Python's own module, or None if it has what the modules may not agree on."""
    span = re.compile(r"\\U([0-9a-f]{8})-\\U([0-9a-f]{8})")
    rest = re.sub(r"\(\?[!:=]", "", span.sub("", exact))
    if "\\" in rest or "(?" in rest or re.search(r"[+*?}]\+|\[\[|--|&&|\|\||~~", rest):
        return None
    latin = span.sub(lambda m: m.group() if int(m[1], 16) < 0x100 else "", exact)
    return None if "[]" in latin or "[^]" in latin else re.compile(latin)


class Bpe:
    """An encoder for one vocabulary; ``library`` is what ``library_pattern`` gives for the pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, library: tuple[str, str] | None = None):
        self.ranks = ranks
        exact, differ = library or library_pattern(pattern)
        self.short, self.exact, self.differ = regex.compile(pattern), regex.compile(exact), regex.compile(differ) if differ else None
        self.latin = latin_pattern(exact) or (self.exact if self.differ and any(map(self.differ.match, map(chr, range(0x100)))) else self.short)
        self.token = {i: b for b, i in ranks.items()}
        self.tokens = pa.array(map(self.token.get, range(max(self.token, default=-1) + 1)), pa.binary())
        self.stable_pairs: dict[tuple[int, int], list[int] | None] = _Bounded(self._seam, CACHED_SEAMS)
        self.windows: dict[bytes, list[int]] = _Bounded(self._merge_by_scan, CACHED_STEPS)
        self.pieces = _Pieces(self)

    # --- leaves and windows -------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a leaf or window; short ones are memoised."""
        return self._merge_by_heap(data) if len(data) > SMALL else self.windows[data]

    def _merge_by_scan(self, data: bytes) -> list[int]:
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_by_heap(self, data: bytes) -> list[int]:
        """The same merges in O(n log n): parts are a linked list of start offsets."""
        n, get = len(data), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def candidate(i: int) -> tuple[int, int, int] | None:
            j = after[i]
            if j >= n:
                return None
            r = get(data[i : after[j]])
            return None if r is None else (r, i, after[j])

        heap = [c for i in range(n - 1) if (c := candidate(i))]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            j = after[i]
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
            for k in (before[i], i):
                if k >= 0 and (c := candidate(k)):
                    heapq.heappush(heap, c)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return out

    def _seam(self, pair: tuple[int, int]) -> list[int] | None:
        """None for a stable pair, else the encoding of its bytes."""
        data = self.token[pair[0]] + self.token[pair[1]]
        merged = self._merge_by_heap(data) if len(data) > SMALL else self._merge_by_scan(data)
        return None if merged == [*pair] else merged

    def stable(self, a: int, b: int) -> bool:
        return self.stable_pairs[a, b] is None

    # --- the monoid ---------------------------------------------------------------------

    def join(self, left: list[int], right: list[int]) -> list[int]:
        seams = self.stable_pairs
        if not left or not right or (window := seams[left[-1], right[0]]) is None:
            return left + right
        i = j = 1
        while True:
            left_ok = i >= len(left) or seams[left[-i - 1], window[0]] is None
            right_ok = j >= len(right) or seams[window[-1], right[j]] is None
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            i = i if left_ok else min(len(left), 2 * i)
            j = j if right_ok else min(len(right), 2 * j)
            window = self.merge(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))

    def encode_bytes(self, data: bytes) -> list[int]:
        """The tree reduction over one piece."""
        if len(data) <= LEAF:
            return self.windows[data]
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def forget(self) -> None:
        """Free what only speeds up: workers live on while other stages need the memory, and most of a task's distinct pieces are new to it."""
        self.stable_pairs.clear()
        self.windows.clear()
        self.pieces.clear()
        self.pieces.old = {}

    # --- texts --------------------------------------------------------------------------

    def pattern_for(self, text: str):
        """For Latin-1 texts that of Python's own module; else the short pattern, unless the text has a character on which it differs from the library's."""
        if text.isascii():
            return self.latin
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.exact if self.differ and self.differ.search(text) else self.short
        return self.latin

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        look, pattern = self.pieces.__getitem__, self.pattern_for(text)
        if len(text) < PIECES_AT_ONCE:
            return b"".join(map(look, pattern.findall(text)))
        pieces, parts = (m.group() for m in pattern.finditer(text)), []
        while part := list(islice(pieces, PIECES_AT_ONCE)):
            parts.append(b"".join(map(look, part)))
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("i").tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        if len(ids) <= DECODE_LEAF:
            some = self.tokens.take(pa.array(ids, pa.int32()))
            _, ends, data = some.buffers()
            return data[: np.frombuffer(ends, np.int32)[len(ids)]].to_pybytes() if len(ids) and data else b""
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def decode_all(self, ids: np.ndarray, ends: list[int]) -> pa.Array:
        """The bytes of texts whose ids follow each other; the first end is 0."""
        sizes = pc.binary_length(self.tokens).fill_null(0).to_numpy()
        parts = [int(sizes[ids[a:b]].sum()) for a, b in zip(ends, ends[1:], strict=False)]
        at = pa.py_buffer(np.cumsum([0, *parts]).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(parts), [None, at, pa.py_buffer(self.decode(ids))])


class _Bounded(dict):
    """Key -> what ``make`` gives for it; emptied when full."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        made = self[key] = self.make(key)
        return made


class _Pieces(dict):
    """Piece -> packed ids. When full, it becomes the old generation and what is still used moves up again."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.bpe.encode_bytes(piece.encode())
            packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


_MADE: dict[tuple[int, str], Bpe] = {}


def bpe_of(raw: bytes, pattern: str, library: tuple[str, str]) -> Bpe:
    """One encoder for each vocabulary and worker; a worker keeps the last one."""
    key = (hash(raw), pattern)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Bpe(read_ranks(raw), pattern, library)
    return _MADE[key]


def bpe_tokens(df: DataFrame, ranks_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """doc_id, ids array<int> and, if asked for, decoded binary (the bytes that the ids stand for)."""
    spark = df.sparkSession
    ship(spark)
    with open(ranks_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not depend on the data
    kind, library = df.schema[doc_id].dataType.simpleString(), library_pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(shared.value, pattern, library)
        try:
            yield from encoded(bpe, batches)
        finally:
            bpe.forget()

    def encoded(bpe: Bpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, start, size = batch.column(0), batch.column(1), 0, 0
            packed: list[bytes] = []
            for row in range(len(texts)):
                packed.append(one := bpe.encode_packed(texts[row].as_py() or ""))
                size += len(one) * 2
                if size > OUT_BYTES or row == len(texts) - 1:
                    ends = [0]
                    for x in packed:
                        ends.append(ends[-1] + len(x) // 4)
                    raw = b"".join(packed)
                    ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(raw)])
                    cols = [keys.slice(start, len(packed)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)]
                    if decode:
                        cols.append(bpe.decode_all(np.frombuffer(raw, np.int32), ends))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])
                    packed, start, size = [], row + 1, 0

    schema = f"doc_id {kind}, ids array<int>" + (", decoded binary" if decode else "")
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = bpe_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_digests(tokens)


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLES: dict[str, str] = {}

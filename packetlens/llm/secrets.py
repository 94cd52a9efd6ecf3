"""Secret scans with multipart credential linking.

Base patterns stand alone: assignments, access identifiers, long hexadecimal strings. Besides them a text has
*parts* that say little alone: identifiers (access keys, user or client names), weak secrets (mixed
strings of 16 or more characters) and endpoints (``scheme://host``). Each part covers its whole scope, a block of
lines without an empty line between (with a reach, only that many characters around it in the scope). An
interval join over the sorted ends meets parts of complementary kinds; a weak secret, an identifier or an endpoint
is reported only if it meets its complement: a secret beside an identifier or an endpoint.

The scan is a narrow map over Arrow batches; each text is searched whole.

Defined results: a null text is empty and has no spans. Spans are in code points, end exclusive, sorted by
start and then kind. Repeated rows are scanned one by one; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, table

#: Order of the kinds in results.
KINDS = ["assign", "access", "hex", "identifier", "endpoint", "weak_secret"]
BASE = KINDS[:3]
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Characters around a part, where a caller of ``find_spans`` does not say; the operator has no such bound.
REACH = 300

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_IDENTIFIER = re.compile(r"\b(?:access_?key_?id|client_?id|account|user(?:name)?|login)[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_.@-]{3,})", re.I | re.A)
_ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>/?#]+(?:/[^\s\"'<>]*)?", re.I | re.A)
_WEAK = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}", re.A)
_BLANK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, the too short ones dropped."""
    out: list[Span] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of 32 or more is the whole run that the shorter pattern would match there
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


def linked_spans(text: str, base: list[Span], reach: int | None = REACH) -> list[Span]:
    """Parts that meet their complement within a scope; no reach: anywhere in it."""
    reach = len(text) if reach is None else reach
    endpoints = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)] if "://" in text else []
    names = [(m.start(), m.end(), "identifier") for m in _IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    if not endpoints and not names and not any(kind == "access" for _, _, kind in base):
        return []
    covered = sorted((s, e) for s, e, _ in base + endpoints + names)
    ends_by = list(accumulate((e for _, e in covered), max))

    def free(s: int, e: int) -> bool:
        i = bisect_left(covered, (e,))
        return i == 0 or ends_by[i - 1] <= s

    weak = [(m.start(), m.end(), "weak_secret") for m in _WEAK.finditer(text) if _mixed(m[0]) and free(m.start(), m.end())]
    role = {"access": "id", "identifier": "id", "endpoint": "at", "weak_secret": "secret", "assign": "secret", "hex": "secret"}
    cuts = [m.start() for m in _BLANK.finditer(text)] + [len(text)]
    parts = []
    for s, e, kind in base + endpoints + names + weak:
        scope = bisect_left(cuts, s)
        first = cuts[scope - 1] if scope else 0
        parts.append((max(first, s - reach), min(cuts[min(scope, len(cuts) - 1)], e + reach), s, e, kind, scope))
    # intervals overlap with those that start by its end, less those that end before its start
    lows: dict[tuple[int, str], list[int]] = {}
    highs: dict[tuple[int, str], list[int]] = {}
    for low, high, _, _, kind, scope in parts:
        lows.setdefault((scope, role[kind]), []).append(low)
        highs.setdefault((scope, role[kind]), []).append(high)
    for ends in (*lows.values(), *highs.values()):
        ends.sort()
    out = []
    for low, high, s, e, kind, scope in parts:
        others = ("id", "at") if role[kind] == "secret" else ("secret",)
        if kind not in BASE and any(bisect_right(lows[k], high) > bisect_left(highs[k], low) for o in others if (k := (scope, o)) in lows):
            out.append((s, e, kind))
    return out


def find_spans(text: str, reach: int | None = REACH) -> list[Span]:
    base = base_spans(text)
    return sorted(base + linked_spans(text, base, reach), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def secret_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>>."""
    ship(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, found = [0], []
            for value in batch.column(1):
                found += find_spans(value.as_py() or "", None)
                ends.append(len(found))
            s, e, k = zip(*found, strict=True) if found else ((), (), ())
            spans = pa.StructArray.from_arrays([pa.array(k, pa.string()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], ["doc_id", "spans"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind string, start int, end int>>")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES: dict[str, str] = {}

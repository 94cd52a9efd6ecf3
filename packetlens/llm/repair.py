"""Conversation structure repair: cheapest edits by Dijkstra's search on the lattice (turn index, grammar state).

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. A message may be kept (K, 0), get the role that fits (R, 2), or
be deleted (D, 3; blank and repeated ones must be), and an empty message may be put in anywhere (I, 2); a truncated message that stays costs 1.
The lattice is never built: the search pops nodes by (cost, audit), where the audit is the edits' letters, and the first popped
node that has all messages and an accepting state is the answer. From a state only one user or assistant message may follow, so
the audit says all: applying it gives the repaired messages.

A conversation streams through its task in segments of 256 messages. All paths pass the nodes at a segment's end, at most one for
each state, so a search that settles these and goes on from them finds what one search over the whole would find. Nodes that
others dominate by more than any later difference are dropped. Held are one segment and at most four audits; audits of one cost at one
node have as many messages and inserts, so none begins another, and best parts make a best whole.

``repair_audits`` returns one row a conversation with its faults and its audit; ``repaired_messages`` streams the messages once more, the audit first,
and returns the repaired ones. Messages are dealt by conversation in both, as the order asks; the sort spills, no conversation is held whole.

Defined results: null roles and texts are one space; null turns come first; rows of one turn are ordered by role and text. Null
conversations are one conversation. Other columns are not read. Rows that ``present`` marks false only name their conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, table

START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a new or changed message gets, and the state after it.
FITS = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ACCEPTING = (START, ASSISTANT)
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SEGMENT = 256


@dataclass
class Path:
    """The best way to a grammar state after some messages."""

    cost: int
    audit: str
    state: int


def search(starts: list[Path], messages: list[tuple[str, bool, bool]], last: bool) -> list[Path]:
    """The best paths through ``messages`` (initial, must go, truncated): to the first accepting end, or, if more follow, to every state."""
    # paths are compared by audit: a start's audit is a rank and a tail, equal ranks where one audit begins the other
    ranked, root, rank = [], None, -1
    for p in sorted(starts, key=lambda p: p.audit):
        if root is None or not p.audit.startswith(root):
            root, rank = p.audit, rank + 1
        ranked.append((p, rank, len(root)))
    heap = [(p.cost, rank, p.audit[root:], 0, p.state, i) for i, (p, rank, root) in enumerate(ranked)]
    heapq.heapify(heap)
    settled, ends = set(), []
    while heap:
        cost, rank, tail, at, state, i = heapq.heappop(heap)
        if (at, state) in settled:
            continue
        settled.add((at, state))
        if at == len(messages):
            start, _, root = ranked[i]
            path = Path(cost, start.audit[:root] + tail, state)
            if last and state in ACCEPTING:
                return [path]
            ends.append(path)
        heapq.heappush(heap, (cost + INSERT, rank, tail + "I", at, FITS[state][1], i))
        if at == len(messages):
            continue
        initial, must_go, truncated = messages[at]
        heapq.heappush(heap, (cost + DELETE, rank, tail + "D", at + 1, state, i))
        if not must_go:
            more = TRUNCATED * truncated
            heapq.heappush(heap, (cost + RELABEL + more, rank, tail + "R", at + 1, FITS[state][1], i))
            if (state, initial) in STEP:
                heapq.heappush(heap, (cost + more, rank, tail + "K", at + 1, STEP[state, initial], i))
    return undominated(ends)


def undominated(paths: list[Path]) -> list[Path]:
    """Without paths that lose to the one after an assistant whatever follows: it can do what the system state can, and all that the start can but keep a system message, which it deletes."""
    limit = {p.state: p.cost for p in paths}.get(ASSISTANT)
    spare = {START: DELETE, SYSTEM: 0}
    return [p for p in paths if limit is None or p.state not in spare or p.cost <= limit + spare[p.state]]


@dataclass
class Conversation:
    """What streams through of one conversation."""

    gaps_low: int | None = None
    gaps_high: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    before: str | None = None
    segment: list = field(default_factory=list)
    paths: list = field(default_factory=lambda: [Path(0, "", START)])

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if turn is not None:
            self.gaps_low = turn if self.gaps_low is None else self.gaps_low
            self.turns += turn != self.gaps_high
            self.gaps_high = turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if len(self.segment) == SEGMENT:
            self.paths, self.segment = search(self.paths, self.segment, False), []
        self.segment.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))

    def close(self) -> tuple:
        (best,) = search(self.paths, self.segment, True)
        gaps = self.gaps_high - self.gaps_low + 1 - self.turns if self.gaps_low is not None else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, best.audit


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages (conv_id, present, turn, initial, fault) in order -> a row for each conversation."""
    out, now, talk, kind = [], None, None, pa.null()

    def rows() -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", *COUNTS, "audit"])

    for batch in batches:
        kind = batch.column(0).type
        for conv, present, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if talk is None or conv != now:
                if talk is not None:
                    out.append((now, *talk.close()))
                now, talk = conv, Conversation()
            if present:
                talk.add(turn, initial, fault)
        if len(out) > 2000:
            yield rows()
            out.clear()
    if talk is not None:
        out.append((now, *talk.close()))
    if out:
        yield rows()


#: The order of a conversation's messages.
ORDER = ["turn", "role", "text"]


def _messages(df: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in df.columns else F.lit(True)
    return df.select("conv_id", present.alias("present"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"))


def repair_audits(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation of ``df`` (conv_id, turn, role, text, maybe present)."""
    ship(df.sparkSession)
    kind = df.schema["conv_id"].dataType.simpleString()
    # one exchange: the windows and the fold need only that a conversation's rows are in one partition
    dealt = _messages(df).repartition("conv_id")
    n = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn"))
    text = F.col("text")
    fault = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("n") > 1, "duplicate").when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    marked = dealt.withColumn("n", n).select("conv_id", "present", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "role", "text", "n")
    ordered = marked.sortWithinPartitions("conv_id", *ORDER, "n").select("conv_id", "present", "turn", "initial", "fault")
    return ordered.mapInArrow(_audited, f"conv_id {kind}, {', '.join(c + ' long' for c in COUNTS)}, audit string")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit, then its messages in order -> the repaired messages."""
    out: list[tuple] = []
    kind, now, audit, at, state, n = pa.null(), None, "", 0, START, 0

    def rows() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "at", "edit", "role", "text"])

    def say(edit: str, role: str, text: str) -> None:
        nonlocal state, n
        state = FITS[state][1] if edit != "K" else STEP[state, role[:1]]
        out.append((now, n, edit, role, text))
        n += 1

    def insert() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            say("I", FITS[state][0], "")
            at += 1

    for batch in batches:
        kind = batch.column(0).type
        for conv, found, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found is not None:
                now, audit, at, state, n = conv, found, 0, START, 0
                insert()
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                say(edit, role if edit == "K" else FITS[state][0], text)
            insert()
        if out:
            yield rows()
            out.clear()


def repaired_messages(df: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, at (from 0), edit (K, R or I), role and text of the repaired messages, in order in each partition."""
    ship(df.sparkSession)
    kind = df.schema["conv_id"].dataType.simpleString()
    nothing = lambda c, t: F.lit(None).cast(t).alias(c)
    first = audits.select("conv_id", "audit", nothing("turn", "long"), nothing("role", "string"), nothing("text", "string"))
    rest = _messages(df).where("present").select("conv_id", nothing("audit", "string"), "turn", "role", "text")
    dealt = first.unionByName(rest).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER)
    return dealt.select("conv_id", "audit", "role", "text").mapInArrow(_applied, f"conv_id {kind}, at long, edit string, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired messages in order -> the digest of each conversation."""
    out, now, sha, kind = [], None, None, pa.null()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind, pa.string()), strict=True)], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.column(0).type
        for conv, at, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at == 0:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = conv, hashlib.sha256()
            sha.update(f"{chr(10) if at else ''}{role}:{text}".encode())
        if len(out) > 2000:
            yield rows()
            out.clear()
    if sha is not None:
        out.append((now, sha.hexdigest()))
    if out:
        yield rows()


def message_digests(messages: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the conversations that have repaired messages."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    return messages.select("conv_id", "at", "role", "text").mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string")


# --- the query ----------------------------------------------------------------------------


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with every twentieth row dropped (not present), emptied, without its stops, repeated, or said by the user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    rows = df.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("how") != 0).alias("present"), copies).drop("col")


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    messages = damaged(table(spark, sf_dir, "conversations"))
    audits = repair_audits(messages)
    said = message_digests(repaired_messages(messages, audits)).withColumnRenamed("conv_id", "said")
    nothing: Column = F.sha2(F.lit(""), 256)
    joined = audits.join(said, audits["conv_id"].eqNullSafe(said["said"]), "left")
    return joined.select("conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def repair_sql() -> str:
    """DuckDB SQL: message by message, the best path to each state, as (cost, audit, repaired text)."""
    crc = (
        "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),"
        " lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    )

    def by(path: str, letter: str, cost: str, piece: str = "''") -> str:
        return f"CASE WHEN {path} IS NOT NULL THEN {{'c': {path}.c + {cost}, 't': {path}.t || '{letter}', 'o': {path}.o || {piece}}} END"

    best = lambda *paths: f"list_min([{', '.join(paths)}])"
    only = lambda test, path: f"CASE WHEN {test} THEN {path} END"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    kept = "chr(10) || role || ':' || text"
    keep = lambda p, x: only(f"NOT gone AND initial = '{x}'", by(p, "K", "cut", kept))
    relabel = lambda p, role: only("NOT gone", by(p, "R", "2 + cut", f"{role} || text"))
    delete = lambda p: by(p, "D", "3")

    def closed(source: str) -> str:
        first = f"SELECT * REPLACE ({best('u', *(by(p, 'I', '2', user) for p in 'esa'))} AS u) FROM ({source})"
        return f"SELECT * REPLACE ({best('a', by('u', 'I', '2', assistant))} AS a) FROM ({first})"

    none = "CAST(NULL AS STRUCT(c BIGINT, t VARCHAR, o VARCHAR))"
    base = f"SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 't': '', 'o': ''}} AS e, {none} AS s, {none} AS u, {none} AS a FROM talks"
    step = f"""SELECT r.conv_id, m.i, {delete("e")} AS e, {best(delete("s"), keep("e", "s"))} AS s,
        {best(delete("u"), *(keep(p, "u") for p in "esa"), *(relabel(p, user) for p in "esa"))} AS u, {best(delete("a"), keep("u", "a"), relabel("u", assistant))} AS a
        FROM r JOIN faults m ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = r.i + 1"""
    one = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    return f"""
WITH RECURSIVE talks AS (SELECT DISTINCT conv_id FROM conversations),
d AS (SELECT conv_id, turn, {one("role")} AS role, {one("text")} AS text, {crc.format(one("conv_id") + " || ':' || " + one("turn"))} % 20 AS how FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
             CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS n FROM l),
f AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN n > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM o),
faults AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut,
                  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f),
r AS ({closed(base)} UNION ALL {closed(step)}),
best AS (SELECT conv_id, {best("e", "a")} AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM r) WHERE back = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, p.c AS cost, p.t AS audit, sha256(substr(p.o, 2)) AS repaired_sha256
FROM best LEFT JOIN counts ON best.conv_id IS NOT DISTINCT FROM counts.conv_id"""


QUERIES = {"op12_structure_repair": op12_structure_repair}
ORACLES = {"op12_structure_repair": repair_sql()}

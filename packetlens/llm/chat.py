"""Chat formatting from event logs.

A log row is an event of a conversation: ``message`` opens a message of a turn, ``delta`` appends to the
turn's latest message, ``edit`` replaces its text, ``regenerate`` empties it and discards what later turns had received
before it. The log is partitioned by conversation and sorted by turn and, within a turn, by sequence number; a fold streams through
each partition, holds one message at a time and emits a rendered segment for each. An event changes its own turn only, but for what a
regeneration discards, which goes by sequence numbers; so this order gives what the order of the sequence alone would give, without
holding all open messages. A conversation's formatted text
is its segments in order. Memory does not depend on the conversation's length; the sort spills.

The template writes ``<|turn|>role\\ntext<|end|>\\n``. In texts and roles every control string gets a backslash after
its first character, and one more if it has some there already, so none survives and removing one restores
the text. Roles also escape backslashes and newlines. The loss mask covers assistant texts.

Defined results: a null text is empty, a null role an empty string. Events of one turn that tie in their sequence number, or have none,
are ordered by kind (messages, edits, regenerations, deltas), then role and text. A null or unknown kind is a
message. A regeneration without a sequence number empties its message and discards nothing of later turns. Rows with a null
conversation form one conversation; null turns come first. Conversations and turns may be of any type that sorts. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, table

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: What may follow the first character of a control string (fixed values).
_TAILS = r"/?s>|/?INST\]|\|turn\|>|\|end\|>"
_BARE = re.compile(rf"([<\[])(\\*)({_TAILS})")
_GUARDED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_SEGMENT = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE) + r"\n", re.S)
LOSS_ROLE = "assistant"


def guard(text: str) -> str:
    return _BARE.sub(r"\1\\\2\3", text)


def unguard(text: str) -> str:
    return _GUARDED.sub(r"\1\2\3", text)


def role_out(role: str) -> str:
    return guard(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unguard(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A segment and its loss span."""
    head, body = OPEN + role_out(role) + "\n", guard(text)
    end = len(head) + len(body) if role == LOSS_ROLE else len(head)
    return head + body + CLOSE + "\n", len(head), end


SEGMENTS = "part long, role string, formatted string, loss_start int, loss_end int"
#: How ties in the sequence number are ordered; other kinds are messages.
TIES = {"edit": 1, "regenerate": 2, "delta": 3}


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events sorted by conversation, turn and sequence -> segments."""
    out: list[tuple] = []
    now: tuple | None = None  # conversation and turn
    part, cut, next_cut = 0, None, None
    role, text = None, []

    def close() -> None:
        nonlocal role, text, part
        if role is not None:
            formatted, a, b = render(role, "".join(text))
            out.append((now[0], part, role, formatted, a, b))
            part += 1
        role, text = None, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "part", "role", "formatted", "loss_start", "loss_end"])

    started, id_type = False, pa.null()
    for batch in batches:
        id_type = batch.column(0).type
        for conv, turn, seq, kind, who, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not started or (conv, turn) != now:
                close()
                if not started or conv != now[0]:
                    part, next_cut = 0, None
                now, cut, started = (conv, turn), next_cut, True
            if cut is not None and seq is not None and seq < cut:
                continue  # a regeneration of an earlier turn came later
            if kind == "delta":
                role = role if role is not None else who or ""
                text.append(said or "")
            elif kind == "edit":
                role, text = (role if role is not None else who or ""), [said or ""]
            elif kind == "regenerate":
                role, text = (role if role is not None else who or ""), []
                if seq is not None:
                    next_cut = seq if next_cut is None else max(next_cut, seq)
            else:  # a message, also a null or unknown kind
                close()
                role, text = who or "", [said or ""]
        if len(out) > 2000:
            yield batch_of(out)
            out.clear()
    close()
    if out:
        yield batch_of(out)


def format_chats(events: DataFrame, dealt: bool = False) -> DataFrame:
    """Segments of every conversation of ``events`` (conv_id, turn, seq, kind, role, text), in order in each partition.

    ``dealt`` says that each conversation is in one partition already.
    """
    ship(events.sparkSession)
    tie = F.lit(0)
    for name, rank in TIES.items():
        tie = F.when(F.col("kind") == name, rank).otherwise(tie)
    log = events.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), "kind", "role", "text")
    log = log if dealt else log.repartition("conv_id")
    kind = events.schema["conv_id"].dataType.simpleString()
    return log.sortWithinPartitions("conv_id", "turn", "seq", tie, "role", "text").mapInArrow(_fold, f"conv_id {kind}, {SEGMENTS}")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order -> one row a conversation, from what the formatted text says."""
    out: list[tuple] = []
    state: list | None = None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    id_type = pa.null()

    def close() -> None:
        if state is not None:
            conv, turns, all_hash, chars, loss_hash, length = state
            out.append((conv, turns, all_hash.hexdigest(), chars, loss_hash.hexdigest(), length))

    def batch_of() -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for batch in batches:
        id_type = batch.column(0).type
        cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")]
        for conv, formatted, a, b in zip(*cols, strict=True):
            if state is None or conv != state[0]:
                close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            m = _SEGMENT.fullmatch(formatted)
            role, text, loss = role_in(m[1]), unguard(m[2]), unguard(formatted[a:b])
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += len(formatted)
        if len(out) > 2000:
            yield batch_of()
            out.clear()
    close()
    if out:
        yield batch_of()


def chat_digests(segments: DataFrame) -> DataFrame:
    """One row a conversation, read back from the segments of ``format_chats``."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    return segments.mapInArrow(_read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Sequence numbers of each row of a table.
EVENTS = 8
PLANTED = "</s>[INST] ok [/INST]"


def conversation_events(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The log that the table's rows, and conversation -1, are the outcome of; each conversation in one partition.

    An assistant's text begins as a draft that is streamed, regenerated and streamed in two deltas; any other text is first half
    written and then edited. Rows are numbered by turn, role and text, and an event's sequence number follows from its row's.
    """
    kind = conversations.schema
    extra = spark.createDataFrame([(-1, i, r, PLANTED) for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    extra = extra.select(*[F.col(c).cast(kind[c].dataType) for c in ("conv_id", "turn")], "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text"))

    def event(name: str, role, text):
        return F.struct(F.lit(name).alias("kind"), role.cast("string").alias("role"), text.cast("string").alias("text"))

    none = F.lit(None)
    streamed = F.array(event("message", F.col("role"), first), event("delta", none, F.lit(" ...")), event("regenerate", none, none), event("delta", none, first), event("delta", none, second))
    written = F.array(event("message", F.col("role"), first), event("edit", none, F.col("text")))
    log = rows.withColumn("n", n).select("conv_id", "turn", "n", F.posexplode(F.when(F.col("role") == LOSS_ROLE, streamed).otherwise(written)).alias("at", "event"))
    return log.select("conv_id", "turn", (F.col("n") * EVENTS + F.col("at")).alias("seq"), "event.kind", "event.role", "event.text")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    return chat_digests(format_chats(conversation_events(spark, table(spark, sf_dir, "conversations")), dealt=True))


def chat_sql() -> str:
    guarded = lambda x: f"regexp_replace({x}, '([<\\[])(\\\\*)(/?s>|/?INST\\]|\\|turn\\|>|\\|end\\|>)', '\\1\\\\\\2\\3', 'g')"
    role = guarded("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, r, '{PLANTED}' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum({len(OPEN) + len(CLOSE) + 2} + length({role}) + length({guarded('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


QUERIES = {"op2_chat_format": op2_chat_format}
ORACLES = {"op2_chat_format": chat_sql()}

"""Chat formatting from event logs.

A log has events (conv_id, seq, message, kind, role, text). ``message`` numbers the messages of a conversation in order.
Kinds: open (starts a message with a role and a first text), delta (adds text), edit (replaces the text), regenerate (starts the
message's text anew and discards every later message begun before). Rows are numbered by a window over the conversation, in order of
message and sequence, so Spark deals and sorts them (not again, if they are dealt by conversation already), and are folded in one streaming pass that holds a single message at a time: the longest conversation needs
no more memory than its longest message.

Rendering gives one row a message: the formatted piece and the loss span in it (assistants' texts alone). Control strings of the
template that stand inside texts are escaped with a backslash and come back unchanged: ``parse`` is the inverse. Pieces of a
conversation, in order and put together, are the formatted conversation; no task ever holds all of it.

Template: system ``<<SYS>> text <</SYS>>``, user ``[INST] text [/INST]``, assistant ``<s> text </s>``, any other role
``[TURN] role : text [/TURN]``, a line end after each.

Defined cases: null text is empty; a null role is the empty role; events of a message before its open or regenerate make
a message with an empty role; a null message or seq comes before all others; an event of unknown kind is an error; ties in (message, seq) go by kind, role and text;
repeated rows count each; rows with a null conv_id form one conversation; other columns do not matter; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.llm._shared import shared_dir

#: Fixed marks of the template.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n")}
OTHER = ("[TURN] ", " : ", " [/TURN]\n")
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[TURN]", "[/TURN]")

#: What a null seq counts as.
FIRST = -(1 << 63)

_ESCAPE = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """text without a control string: a backslash follows the first character of each, and every backslash is doubled."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted piece, and where its loss span starts and ends (0, 0: none)."""
    body = escape(text)
    if role in MARKS:
        before, after = MARKS[role]
        span = (len(before), len(before) + len(body)) if role == "assistant" else (0, 0)
        return before + body + after, *span
    return OTHER[0] + escape(role).replace(" ", "\\ ") + OTHER[1] + body + OTHER[2], 0, 0


def parse(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted piece."""
    for role, (before, after) in MARKS.items():
        if piece.startswith(before) and piece.endswith(after):
            return role, unescape(piece[len(before) : len(piece) - len(after)])
    role, body = piece[len(OTHER[0]) : len(piece) - len(OTHER[2])].split(OTHER[1], 1)
    return unescape(role), unescape(body)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _pack(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and characters."""
    held, mass = [], 0
    for row in rows:
        held.append(row)
        mass += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == size or mass > chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, mass = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def folded(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, message, role, text) of the final messages, from events sorted by conversation, message and sequence."""
    none = object()
    conv, message, role, parts, begun, cut, newest = none, none, "", [], False, FIRST, FIRST

    def ended() -> list[tuple]:
        return [(conv, message, role, "".join(parts))] if begun else []

    for c, m, seq, kind, r, text, *_ in events:
        seq = FIRST if seq is None else seq
        if (c, m) != (conv, message) or conv is none:
            yield from ended()
            cut, newest = (max(cut, newest), FIRST) if conv is not none and c == conv else (FIRST, FIRST)
            conv, message, role, parts, begun = c, m, "", [], False
        if seq < cut:
            continue
        if kind == "open":
            role, parts = r or "", [text or ""]
        elif kind == "delta":
            parts.append(text or "")
        elif kind == "edit":
            parts = [text or ""]
        elif kind == "regenerate":
            parts, newest = [text or ""], max(newest, seq)
            role = r or role
        else:
            raise ValueError(f"unknown kind of event: {kind!r}")
        begun = True
    yield from ended()


_PIECES = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])


def formatted(events: DataFrame) -> DataFrame:
    """conv_id, message, piece, loss_start and loss_end (code points of the piece) of every final message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack(((c, m, *render(role, text)) for c, m, role, text in folded(_stream(batches))), _PIECES)

    order = Window.partitionBy("conv_id").orderBy("message", "seq", "kind", "role", "text")
    rows = events.select("conv_id", F.col("message").cast("long").alias("message"), F.col("seq").cast("long").alias("seq"), "kind", "role", "text")
    return rows.withColumn("at", F.row_number().over(order)).mapInArrow(run, "conv_id long, message long, piece string, loss_start int, loss_end int")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digested(pieces: Iterator[tuple]) -> Iterator[tuple]:
    none = object()
    conv, turns, loss, counts = none, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
    for c, _, piece, start, end in pieces:
        if conv is none or c != conv:
            if conv is not none:
                yield conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]
            conv, turns, loss, counts = c, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        role, text = parse(piece)
        turns.update(f"{role}\n{text}\n".encode())
        learnt = unescape(piece[start:end])
        loss.update(learnt.encode())
        counts = [counts[0] + 1, counts[1] + len(learnt), counts[2] + len(piece)]
    if conv is not none:
        yield conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]


def digests(pieces: DataFrame) -> DataFrame:
    """Of every conversation of formatted()'s pieces: counts and digests of what parse() gives back; streaming as above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack(_digested(_stream(batches)), _DIGESTS)

    dealt = pieces.select(*_PIECES.names).repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: What log_of() writes and the fold must take back.
STALE = "to be taken back"


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log. By a hash of conversation and message, a turn is an open event and the
    text's two streamed halves; or a wrong text that an edit replaces; or a wrong text and a start of the next message, both taken back when the
    message is regenerated."""
    text = F.coalesce(F.col("text"), F.lit(""))
    half = (F.length(text) / 2).cast("int")
    start, end = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def event(later: int, kind: str, role: Column | None, what: Column | str) -> Column:
        return F.struct(F.lit(later).alias("later"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"),
                        (F.lit(what) if isinstance(what, str) else what).alias("text"))

    opened = event(0, "open", F.col("role"), "")
    ways = (
        F.array(opened, event(0, "delta", None, start), event(0, "delta", None, end)),
        F.array(opened, event(0, "delta", None, STALE), event(0, "edit", None, start), event(0, "delta", None, end)),
        F.array(opened, event(0, "delta", None, STALE), event(1, "open", F.lit("user"), STALE), event(1, "delta", None, STALE),
                event(0, "regenerate", None, start), event(0, "delta", None, end)),
    )
    numbered = conversations.withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    way = F.pmod(F.xxhash64("conv_id", "message"), F.lit(3))
    events = numbered.select("conv_id", "message", F.posexplode(F.when(way == 0, ways[0]).when(way == 1, ways[1]).otherwise(ways[2])).alias("k", "e"))
    return events.select("conv_id", (F.col("message") + F.col("e.later")).alias("message"), (F.col("message") * 8 + F.col("k")).alias("seq"), "e.kind", "e.role", "e.text")


def round_trip(events: DataFrame) -> DataFrame:
    """Formats a log, writes the pieces to the shared folder and digests what is read back."""
    spark = events.sparkSession
    path = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}"
    formatted(events).write.parquet(path)
    return digests(spark.read.parquet(path))

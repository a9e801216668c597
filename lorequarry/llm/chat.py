"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by turn and sequence. One streaming pass folds it: a message
event opens a message, deltas append to it, an edit replaces it, a regeneration empties it and drops every later turn that
the log held before. Messages render as ``<|im_start|>role`` newline ``text<|im_end|>`` newline. A task holds one message
at a time, however long a conversation is.

Control strings inside texts are escaped reversibly: in ``<``, any number of backslashes, ``|``, one backslash is added;
reading removes one. No control string can then occur in a text.

Defined results: a null text is empty, a null role is the empty role, null conversation ids form one conversation, null
turns come first; rows of one conversation that share a turn stay separate messages in order of sequence, role and text,
repeated ones too; an empty table gives no conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_OUT, _BACK = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)
SEGMENTS = "conv_id long, ordinal long, segment string, loss_start long, loss_end long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _OUT.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line: backslashes and line breaks are escaped first."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def messages(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as a log of message events."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("turn").cast("long").alias("seq"),
        F.lit("message").alias("kind"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, turn, seq, kind, role, text), sorted, to final messages (conv, role, text).

    Turns arrive in order, so a regeneration has been seen before any later turn that it drops.
    """
    conv, turn, reset, held = object(), object(), None, None
    for c, t, seq, kind, role, text in events:
        if held and (c != conv or t != turn or kind == "message"):
            yield conv, held[0], "".join(held[1])
            held = None
        if c != conv:
            conv, reset, inherited = c, None, None
        if t != turn:
            inherited = reset
        turn = t
        if inherited is not None and seq is not None and seq < inherited:
            continue
        if kind == "message" or held is None:
            held = [role, [text]]
            continue
        if kind == "delta":
            held[1].append(text)
        else:
            held[1] = [text]
            if kind == "regenerate":
                reset = max(seq, reset) if reset is not None else seq
    if held:
        yield conv, held[0], "".join(held[1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _emit(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = [("conv_id", pa.int64()), ("ordinal", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
    conv, at, k, held, size = object(), 0, 0, [], 0
    for c, role, text in fold(_rows(batches)):
        if c != conv:
            conv, at, k = c, 0, 0
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        segment, start = f"{head}{body}{CLOSE}\n", at + len(head)
        held.append((c, k, segment, *((start, start + len(body)) if role == LEARNED else (None, None))))
        at, k, size = at + len(segment), k + 1, size + len(segment)
        if size > 1 << 22 or len(held) >= 5000:
            yield _emit(held, schema)
            held, size = [], 0
    if held:
        yield _emit(held, schema)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    conv, state, out = None, None, []
    done = lambda: (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
    for c, _, segment, start, end in _rows(batches):
        if state is None or c != conv:
            if state is not None:
                out.append(done())
            conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        for role, text in _TURN.findall(segment):
            state[0] += 1
            state[1].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
        if start is not None:
            learned = unescape(segment[start - state[4] : end - state[4]])
            state[2] += len(learned)
            state[3].update(learned.encode())
        state[4] += len(segment)
        if len(out) >= 5000:
            yield _emit(out, schema)
            out = []
    if state is not None:
        out.append(done())
    if out:
        yield _emit(out, schema)


def format_chat(events: DataFrame) -> DataFrame:
    """Rendered conversations in order, one segment per final message: conv_id, ordinal, segment, loss_start, loss_end.

    The formatted conversation is its segments joined; the loss mask's spans are code points of that whole.
    """
    log = events.select("conv_id", "turn", "seq", "kind", "role", "text")
    return log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text").mapInArrow(_render, SEGMENTS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the rendered segments hold, parsed again; takes the stream of ``format_chat`` as it comes."""
    return formatted.mapInArrow(_read_back, DIGEST)


def digest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The contract's rows: every conversation, and conversation -1 whose two texts are control strings."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(f"{CLOSE}{OPEN}{LEARNED} ok").alias("text"))
    return read_back(format_chat(messages(rows.select("conv_id", "turn", "role", "text").unionByName(probe))))

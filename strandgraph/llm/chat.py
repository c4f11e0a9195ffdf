"""Chat formatting from event logs.

A log is partitioned by conversation and sorted by sequence; streamed deltas,
edits and regenerations are folded into final messages, which are rendered with
turn marks.  Control strings inside texts get a backslash after their first
character (one more, where backslashes stand there), so that no text can end a
turn and the original is read back exactly.

Events: ``message`` adds a message at a turn; ``delta`` appends to the last
message of the turn (and begins one, if there is none); ``edit`` replaces its
text; ``regenerate`` removes the turn's messages and all of later turns, and
begins an empty message at the turn; ``delete`` removes the turn's messages.

Defined results: null texts and roles are empty; a null or unknown event kind
counts as ``message``; events of equal sequence are taken by turn, kind, role
and text; repeated rows are repeated events; rows with a null conversation form
one conversation with a null id; a conversation without messages renders to an
empty string; extra columns are ignored.  One conversation is held in memory at
a time, as its rendered text is one value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that models or templates take as marks.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_rest = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_ADD, _TAKE = re.compile(rf"([<\[])(\\*)(?=(?:{_rest}))"), re.compile(rf"([<\[])\\(\\*)(?=(?:{_rest}))")


def escape(text: str) -> str:
    """The text without control strings, reversibly."""
    return _ADD.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _TAKE.sub(r"\1\2", text)


def fold(events: Iterable[tuple]) -> list[tuple[int | None, str, str]]:
    """Sorted events ``(kind, turn, role, text)`` -> final messages ``(turn, role, text)`` by turn."""
    said: list[list] = []  # turn, role, parts

    def last(turn: int | None) -> list | None:
        return next((m for m in reversed(said) if m[0] == turn), None)

    for kind, turn, role, text in events:
        if kind == "regenerate":
            said = [m for m in said if turn is not None and m[0] is not None and m[0] < turn]
            said.append([turn, role or "", [text or ""]])
        elif kind == "delete":
            said = [m for m in said if m[0] != turn]
        elif kind == "edit" and (m := last(turn)):
            m[2] = [text or ""]
        elif kind == "delta" and (m := last(turn)):
            m[2].append(text or "")
        else:
            said.append([turn, role or "", [text or ""]])
    said.sort(key=lambda m: (m[0] is not None, m[0] or 0))
    return [(t, r, "".join(parts)) for t, r, parts in said]


def render(messages: list[tuple], masked: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of the text that a loss is taken over."""
    out, spans, at = [], [], 0
    for _, role, text in messages:
        head = f"{START}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
        body = escape(text)
        if role == masked:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        out.append((role, unescape(body[: -len(END) - 1])))
    return out


def format_conversations(events: DataFrame) -> DataFrame:
    """``events(conv_id, seq, kind, turn, role, text)`` -> ``(conv_id, formatted, loss_spans)``."""
    schema = "conv_id long, formatted string, loss_spans array<struct<begin:int,end:int>>"
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string()), pa.array([[{"begin": a, "end": z} for a, z in h[2]] for h in held], span)], ["conv_id", "formatted", "loss_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for conv, events in groupby(rows(batches), key=lambda r: r[0]):
            text, spans = render(fold(e[1:] for e in events))
            held.append((conv, text, spans))
            size += len(text)
            if size > 2_000_000:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    cols = [F.col("conv_id").cast("long"), F.col("seq").cast("long"), F.col("kind").cast("string"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    src = events.select(*[c.alias(n) for c, n in zip(cols, ("conv_id", "seq", "kind", "turn", "role", "text"), strict=True)])
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "kind", "role", "text")
    return src.select("conv_id", "kind", "turn", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a formatted conversation says, from its output alone."""

    def digest(text: str, spans: list) -> tuple:
        turns, loss, n = hashlib.sha256(), hashlib.sha256(), 0
        said = parse(text)
        for role, body in said:
            turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        for s in spans:
            part = unescape(text[s["begin"] : s["end"]])
            n += len(part)
            loss.update(part.encode("utf-8", "surrogatepass"))
        return len(said), turns.hexdigest(), n, loss.hexdigest(), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [digest(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as the log of a chat service that ends in these messages.

    Rows stand by turn (then role and text); their places are the log's turns.
    Every text arrives in two parts, a message and a delta; every third message
    begins as a draft that an edit replaces, and each conversation's last one is
    a draft that is regenerated.
    """
    by = Window.partitionBy("conv_id")
    rows = conversations.select("conv_id", F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(by.orderBy("turn", "role", "text")).cast("long").alias("p"), F.count("*").over(by).alias("n"))
    half = F.floor(F.length("text") / 2).cast("int")
    begin, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    draft, delta = event("message", F.concat(F.lit("draft "), begin)), event("delta", rest)
    log = F.when(F.col("p") == F.col("n"), F.array(draft, event("regenerate", F.lit("")), event("delta", begin), delta))
    log = log.when(F.col("p") % 3 == 0, F.array(draft, event("edit", begin), delta)).otherwise(F.array(event("message", begin), delta))
    said = rows.select("conv_id", "role", "p", F.posexplode(log).alias("i", "e"))
    return said.select("conv_id", (F.col("p") * 4 + F.col("i")).alias("seq"), "e.kind", F.col("p").alias("turn"), "role", "e.text")

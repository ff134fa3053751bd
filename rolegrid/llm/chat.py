"""Chat formatting from event logs: conversations are rebuilt event by event, then rendered with a loss mask.

Events of a conversation, in order of their sequence number:

``message``     a new turn with role and text
``delta``       text added to the last turn of that number; a new turn if there is none
``edit``        new text of the last turn of that number
``regenerate``  the last turn of that number is emptied and all turns after it go; deltas then fill it again

Logs are partitioned by conversation and sorted; a task folds them one after the other and holds one conversation
at a time. Rendering: ``### role: text </turn>`` and a newline for each turn. Inside roles and texts a backslash is
doubled and ``###`` and ``</turn>`` (in roles the colon too) get backslashes, so no control string can occur there
and ``read_back`` restores every turn. The loss mask covers the texts of assistant turns.

Defined results: a null text is empty, a null role is empty; null numbers sort first; events that agree in
conversation and sequence number are taken in order of turn, kind, role and text; a null conversation is one
conversation; an unknown kind and an edit or regeneration of a turn that is not there change nothing; an empty table
gives an empty table. Columns beyond the named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import map_batches

HEAD, TAIL, LEARNED = "### ", " </turn>\n", "assistant"
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "#\\#\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the code point spans under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role).replace(':', chr(92) + ':')}: ", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + TAIL)
        at += len(out[-1])
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split("</turn>\n")[:-1]:
        end = re.match(r"(?:[^\\:]|\\.)*", part, re.S).end()
        turns.append((unescape(part[len(HEAD) : end]), unescape(part[end + 2 : -1])))
    return turns


@dataclass
class Conversation:
    """State of one conversation; ``turns`` are [number, role, pieces of text]."""

    turns: list[list] = field(default_factory=list)

    def apply(self, kind: str, number: int | None, role: str, text: str) -> None:
        at = next((i for i in range(len(self.turns) - 1, -1, -1) if self.turns[i][0] == number), None) if kind != "message" else None
        if kind == "message" or kind == "delta" and at is None:
            self.turns.append([number, role, [text]])
        elif kind == "delta":
            self.turns[at][2].append(text)
        elif kind == "edit" and at is not None:
            self.turns[at][2] = [text]
        elif kind == "regenerate" and at is not None:
            self.turns[at][2] = []
            del self.turns[at + 1 :]

    def messages(self) -> list[tuple[str, str]]:
        return [(role, "".join(pieces)) for _, role, pieces in self.turns]


SPANS = "array<struct<start:bigint,stop:bigint>>"


def formatted(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` from ``conv_id, seq, kind, turn, role, text``."""
    key = events.schema["conv_id"].dataType.simpleString()

    def row(conv, state):
        text, spans = render(state.messages())
        return conv, text, [{"start": a, "stop": b} for a, b in spans]

    def fold(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for conv, kind, number, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row(now, state))
                    now, state = conv, Conversation()
                state.apply(kind, number, role or "", text or "")
            yield from _rows(out, batch.schema.field(0).type)
        if state is not None:
            yield from _rows([row(now, state)], batch.schema.field(0).type)

    ordered = events.select("conv_id", "seq", "kind", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "kind", "role", "text")
    return ordered.mapInArrow(fold, f"conv_id {key}, formatted string, loss_spans {SPANS}")


def _rows(rows: list[tuple], key: pa.DataType):
    if rows:
        conv, text, spans = zip(*rows)
        kinds = (key, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((conv, text, spans), kinds)], ["conv_id", "formatted", "loss_spans"])


def digest(conversations: DataFrame) -> DataFrame:
    """Turns, loss text and lengths of formatted conversations, read back from their text and mask."""
    key = conversations.schema["conv_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        return [batch.column(0), *(zip(*out) if out else [[]] * 5)]

    kind = f"conv_id {key}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_batches(conversations.select("conv_id", "formatted", "loss_spans"), run, kind)


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as an event log: one message for each row, in order of its turn."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")

"""Chat formatting with a prefix tree.

Conversations are dealt out in the order of their turns' hashes, so those that share initial turns are neighbours,
and a first turn shared by any number of them spans as many partitions as it needs. A partition packs its
conversations into sequences: turns are inserted in a tree, shared ones are emitted once, depth first, and each node
has its position ids' start and the intervals of the sequence that it may attend to (its ancestors and itself).
Tokens are code points.

The template: ``[INST]<<role>>text[/INST]`` for any role but the assistant's, ``text</s>`` for the assistant. Inside roles and
texts a backslash goes before each backslash, ``<``, ``>`` and ``[``; no control string can then occur there, and
dropping these backslashes gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, written

#: Code points after which a sequence is closed, and turns whose hashes order the conversations.
SEQUENCE_CHARS, PATH_TURNS = 1 << 18, 8

_SPECIAL = re.compile(r"[\\<>\[]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where in it the loss mask starts and ends (empty but for the assistant)."""
    body = escape(text)
    if role == "assistant":
        return body + "</s>", 0, len(body)
    return f"[INST]<<{escape(role)}>>{body}[/INST]", 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if formatted.startswith("[INST]<<", at):
            close = _until(formatted, at + 8, ">>")
            end = _until(formatted, close + 2, "[/INST]")
            turns.append((unescape(formatted[at + 8 : close]), unescape(formatted[close + 2 : end])))
            at = end + 7
        else:
            end = _until(formatted, at, "</s>")
            turns.append(("assistant", unescape(formatted[at:end])))
            at = end + 4
    return turns


def _until(text: str, at: int, control: str) -> int:
    """Where the control string next stands unescaped; inside texts its first character always is escaped."""
    while True:
        found = text.index(control, at)
        slashes = found
        while slashes > at and text[slashes - 1] == "\\":
            slashes -= 1
        if (found - slashes) % 2 == 0:
            return found
        at = found + 1


class Sequence:
    """The prefix tree of some conversations and its depth-first layout."""

    def __init__(self) -> None:
        self.children: list[dict[tuple[str, str], int]] = [{}]
        self.turns: list[tuple[str, int, int]] = [("", 0, 0)]
        self.leaves: list[tuple[int | None, int]] = []
        self.chars = 0

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        node = 0
        for turn in turns:
            if (child := self.children[node].get(turn)) is None:
                child = len(self.turns)
                self.children[node][turn] = child
                self.children.append({})
                self.turns.append(format_turn(*turn))
                self.chars += len(self.turns[child][0])
            node = child
        self.leaves.append((conv_id, node))

    def row(self, sequence_id: int) -> dict:
        order, place, text, at = [], {}, [], 0
        stack = [(child, -1) for child in reversed(self.children[0].values())]
        columns: dict[str, list] = {k: [] for k in ("starts", "lengths", "positions", "loss_starts", "loss_ends", "parents", "attends")}
        while stack:
            node, parent = stack.pop()
            formatted, loss_lo, loss_hi = self.turns[node]
            place[node] = mine = len(order)
            order.append(node)
            end = at + len(formatted)
            before = columns["attends"][parent] if parent >= 0 else []
            # a parent that ends where its child starts makes one interval with it
            merged = [*before[:-1], before[-1][:1] + [end]] if before and before[-1][1] == at else [*before, [at, end]]
            position = columns["positions"][parent] + columns["lengths"][parent] if parent >= 0 else 0
            for name, value in zip(columns, (at, len(formatted), position, at + loss_lo, at + loss_hi, parent, merged)):
                columns[name].append(value)
            text.append(formatted)
            at = end
            stack.extend((child, mine) for child in reversed(self.children[node].values()))
        return {"sequence_id": sequence_id, "text": "".join(text), **columns, "conv_ids": [c for c, _ in self.leaves], "leaves": [place.get(n, -1) for _, n in self.leaves]}


_SEQUENCE = "sequence_id bigint, text string, starts array<bigint>, lengths array<bigint>, positions array<bigint>, loss_starts array<bigint>, loss_ends array<bigint>, parents array<bigint>, attends array<array<array<bigint>>>, conv_ids array<bigint>, leaves array<bigint>"
_LONGS = pa.list_(pa.int64())
_SEQUENCE_ARROW = pa.schema([("sequence_id", pa.int64()), ("text", pa.string()), *((n, _LONGS) for n in ("starts", "lengths", "positions", "loss_starts", "loss_ends", "parents")), ("attends", pa.list_(pa.list_(_LONGS))), ("conv_ids", _LONGS), ("leaves", _LONGS)])


def format_conversations(rows: DataFrame, sequence_chars: int = SEQUENCE_CHARS) -> DataFrame:
    """Packed sequences of all conversations, as read back from the shared folder.

    ``rows``: conv_id, turn, role, text. Null texts and roles count as empty, null turns come first, and rows that
    agree in the turn are in order of role and text; a null conv_id is a conversation of its own. A conversation is the
    unit of output, so its turns are held together. Other columns are ignored; an empty table gives no rows.
    """
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    convs = convs.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"), F.transform(F.slice("turns", 1, PATH_TURNS), lambda t: F.xxhash64(t["role"], t["text"])).alias("path"))
    total = turns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(rows.sparkSession, total, 32 << 20)
    ordered = convs.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "roles", "texts")

    def run(batches):
        from pyspark import TaskContext

        base, number, sequence = TaskContext.get().partitionId() << 32, 0, Sequence()
        for batch in batches:
            for conv, roles, texts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sequence.add(conv, list(zip(roles, texts)))
                if sequence.chars >= sequence_chars:
                    yield pa.RecordBatch.from_pylist([sequence.row(base + number)], _SEQUENCE_ARROW)
                    number, sequence = number + 1, Sequence()
        if sequence.leaves:
            yield pa.RecordBatch.from_pylist([sequence.row(base + number)], _SEQUENCE_ARROW)

    return written(ordered.mapInArrow(run, _SEQUENCE), "chat")


def read_conversation(row: dict, leaf: int) -> tuple[str, str]:
    """A conversation's formatted text, through its leaf's attention intervals, and its unescaped text under the loss mask."""
    text, path = row["text"], []
    formatted = "".join([text[a:b] for a, b in row["attends"][leaf]])
    while leaf >= 0:
        path.append(leaf)
        leaf = row["parents"][leaf]
    return formatted, "".join([unescape(text[row["loss_starts"][n] : row["loss_ends"][n]]) for n in reversed(path)])


def conversation_digests(sequences: DataFrame) -> DataFrame:
    """Per conversation, from the sequences: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = []
                for conv, leaf in zip(row["conv_ids"], row["leaves"]):
                    formatted, loss = read_conversation(row, leaf)
                    turns = parse(formatted)
                    whole = "".join([f"{role}\n{text}\n" for role, text in turns])
                    out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return sequences.select("text", "parents", "loss_starts", "loss_ends", "attends", "conv_ids", "leaves").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

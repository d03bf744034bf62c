"""Conversations as one training text each, with turns that can be read back and a mask of what the model learns.

The grammar, one production per role, after ``<s>`` at the start of a conversation:

    user       [INST] text [/INST]
    assistant   text </s>                 (a space stands before the text)
    system     <<SYS>>\\n text \\n<</SYS>>\\n\\n
    others     [ROLE name] text [/ROLE]   (the name percent-encoded)

The parser is deterministic: the first characters tell the production, and a text ends at the next control string that has no
backslash before it, which must be the one that closes its production. Reading takes one backslash away before every
control string within a text.

A turn is rendered as it is, parsed, and compared to its source. If the text read back differs, or the parser stops, the text conflicts with
the grammar; then one backslash is put before each control string in it, which is what reading takes away, and the turn is parsed again.
A turn that still differs is an error, so nothing that cannot be read back is ever returned.

Turns are sorted by conversation and streamed, so a task holds some turns, never a conversation.

Edge cases: a null text counts as empty, a null role as the empty name; a null conversation id is a conversation of its
own, a null turn comes first; turns with one number follow each other by role and text, repeated rows are turns each; no rows
give no rows; only the four named columns are read, whatever further ones are called.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.arrow import small_batches

START = "<s>"
#: What opens and closes a role's text.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
NAMED = ("[ROLE ", "] ", " [/ROLE]")
#: The control strings; none can begin within another, as none holds the sign that begins one after its own start.
CONTROL = r"<s>|</s>|\[/?INST\]|<<SYS>>|<</SYS>>|\[ROLE [A-Za-z0-9%._~-]*\]|\[/ROLE\]"
LEARNED = frozenset(["assistant"])

_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(rf"\\({CONTROL})")
_OPENING = re.compile(r"\[INST\] |<<SYS>>\n|\[ROLE ([A-Za-z0-9%._~-]*)\] | ")
_BY_OPENING = {opening: role for role, (opening, _) in MARKS.items()}


def escape(text: str) -> str:
    """One backslash more before every control string."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    """One backslash less before every control string that has one."""
    return _ESCAPED.sub(r"\1", text)


def marks(role: str) -> tuple[str, str]:
    """What stands before and after a text of this role."""
    return MARKS.get(role) or (NAMED[0] + quote(role, safe="").replace("~", "%7E") + NAMED[1], NAMED[2])


class GrammarError(ValueError):
    """The text is none that the grammar produces."""


def parse_turn(text: str, at: int = 0) -> tuple[str, int, int, int]:
    """Role, start and end of the text, and where the next turn begins, of the turn that begins at ``at``."""
    opening = _OPENING.match(text, at)
    if not opening:
        raise GrammarError(f"no turn begins at {at}")
    role = _BY_OPENING[opening[0]] if opening[1] is None else unquote(opening[1])
    closing, start = marks(role)[1], opening.end()
    for control in _CONTROL.finditer(text, start):
        if control.start() > start and text[control.start() - 1] == "\\":
            continue
        end = control.start() - 1  # the closing begins with one white space
        if end < start or not text.startswith(closing, end):
            break
        return role, start, end, end + len(closing)
    raise GrammarError(f"the turn at {at} is not closed as it was opened")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a whole conversation."""
    if not text.startswith(START):
        raise GrammarError("no conversation begins here")
    turns, at = [], len(START)
    while at < len(text):
        role, start, end, at = parse_turn(text, at)
        turns.append((role, unescape(text[start:end])))
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and where its text stands, escaped if and only if it could not be read back otherwise."""
    opening, closing = marks(role)
    for body in (text, escape(text)):
        rendered = opening + body + closing
        try:
            read, start, end, after = parse_turn(rendered)
        except GrammarError:
            continue
        if read == role and after == len(rendered) and unescape(rendered[start:end]) == text:
            return rendered, start, end
    raise GrammarError(f"a turn of {role!r} cannot be read back")


FORMATTED = "position long, segment string, loss_start long, loss_end long"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of sorted turns; offsets count from the start of the conversation."""
    current: object = _format  # no conversation yet
    position = at = 0
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "role", "text")]):
            role, lead = role or "", ""
            if conv != current:
                current, position, at, lead = conv, 0, 0, START
            rendered, start, end = render_turn(role, text or "")
            at += len(lead)
            learned = role in LEARNED
            for column, value in zip(out, (position, lead + rendered, at + start if learned else None, at + end if learned else None)):
                column.append(value)
            position, at = position + 1, at + len(rendered)
        yield pa.record_batch([batch.column("conv"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()),
                               pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                              ["conv", "position", "segment", "loss_start", "loss_end"])


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """``conv``, ``position``, ``segment``, ``loss_start``, ``loss_end``: the formatted conversations turn by turn. The segments of a conversation,
    put together by position, are its text; the offsets are code points in that text (end exclusive), null where nothing is learned."""
    small_batches(turns.sparkSession)
    kind = turns.schema[conv].dataType.simpleString()
    return (turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"),
                         F.col(f"`{text}`").alias("text"))
            .repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
            .mapInArrow(_format, f"conv {kind}, {FORMATTED}"))


class _Reader:
    """Reads one formatted conversation from its segments, cut anywhere, and digests the turns and the learned text."""

    def __init__(self) -> None:
        self.rest, self.read, self.turns, self.loss, self.begun = "", 0, 0, 0, False
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()
        self.spans: list[tuple[int, int]] = []

    def feed(self, segment: str, masked: tuple[int, int] | None) -> None:
        self.rest += segment
        if masked:
            self.spans.append(masked)
        if not self.begun:
            if len(self.rest) < len(START):
                return
            if not self.rest.startswith(START):
                raise GrammarError("no conversation begins here")
            self.begun, self.read, self.rest = True, len(START), self.rest[len(START):]
        at = 0
        while at < len(self.rest):
            try:
                role, start, end, after = parse_turn(self.rest, at)
            except GrammarError:
                break  # the rest of the turn may follow
            body = unescape(self.rest[start:end])
            self.turns += 1
            self.all.update(f"{role}\n{body}\n".encode())
            while self.spans and self.spans[0][1] <= self.read + after:
                a, b = self.spans.pop(0)
                learned = unescape(self.rest[a - self.read:b - self.read])
                self.loss += len(learned)
                self.learned.update(learned.encode())
            at = after
        self.read, self.rest = self.read + at, self.rest[at:]

    def result(self) -> tuple:
        if self.rest or self.spans:
            raise GrammarError("a conversation ends within a turn")
        return self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.read


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, reader = None, None

    def out(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * 6
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = None
    for batch in batches:
        done, kind = [], batch.column("conv").type
        for conv, segment, a, b in zip(*[batch.column(c).to_pylist() for c in ("conv", "segment", "loss_start", "loss_end")]):
            if reader is None or conv != current:
                if reader is not None:
                    done.append((current, *reader.result()))
                current, reader = conv, _Reader()
            reader.feed(segment, None if a is None else (a, b))
        yield out(done, kind)
    if reader is not None:
        yield out([(current, *reader.result())], kind)


def read_conversations(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What the parser reads from formatted conversations, one row each: ``conv``, the number and digest of the turns (role, line break, text,
    line break), characters and digest of the text under the loss mask, and the characters of the formatted text. ``in_order``: the rows come straight from
    :func:`format_conversations`, each conversation's together and sorted; others are brought into that order first."""
    kind = formatted.schema["conv"].dataType.simpleString()
    if not in_order:
        small_batches(formatted.sparkSession)
        formatted = formatted.repartition("conv").sortWithinPartitions("conv", "position")
    return formatted.select("conv", "segment", "loss_start", "loss_end").mapInArrow(_read, f"conv {kind}, {READ}")

r"""Chat formatting with offset-aligned loss masks.

Template: each turn is ``### <role>: <text> </turn>\n``. In roles and texts a backslash is put before each
backslash, ``###`` and ``</turn>`` (and before ``:`` in roles), so a control string in a text is never one of the template and
the text can be read back exactly.

A conversation is cut into stretches of whole turns by a running sum of its characters: a stretch ends with the turn that
reaches the next multiple of ``STRETCH``. Rows are dealt out by conversation and stretch, so that the stretches of a very long
conversation are encoded in many tasks, and a task holds one of them at a time. A stretch is rendered, encoded once with offsets, and the sorted spans of the assistant's texts are intersected with the token spans by
binary search. The loss mask has a token where its span meets a text's span, and the characters
where they meet; a token that reaches over the edge of a text counts with its part inside only. As a stretch begins
after a line end and the pre-tokeniser never joins text across ``\n#``, tokens are those of the whole conversation.

Defined cases: null text or role is the empty string; turns in order (null first), ties by role and text; repeated
rows are turns of their own; a null conv_id is a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, rows_of
from .tokens import default_path

OPEN, CLOSE, COLON = "### ", " </turn>\n", ": "
LEARNT = "assistant"
#: Characters of a conversation that are rendered and encoded at a time; its last turn may go beyond.
STRETCH = 1 << 20
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
#: A token of the rendered form: an escape, or a control string that no backslash guards.
_SCAN = re.compile(r"\\(?:\\|###|</turn>|:)|### |: | </turn>\n")


def escaped(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted turns and the (start, end) spans of the learnt texts, ascending."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped(role, True)}{COLON}", escaped(text)
        if role == LEARNT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted stretch."""
    turns: list[tuple[str, str]] = []
    place, at, role = 0, 0, ""  # place: 0 before a turn, 1 in its role, 2 in its text
    for m in _SCAN.finditer(formatted):
        if m[0][0] == "\\":
            continue
        if place == 0 and m[0] == OPEN:
            place, at = 1, m.end()
        elif place == 1 and m[0] == COLON:
            role, place, at = unescaped(formatted[at : m.start()]), 2, m.end()
        elif place == 2 and m[0] == CLOSE:
            turns.append((role, unescaped(formatted[at : m.start()])))
            place = 0
    return turns


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens are learnt, and the character pieces under the mask, from ascending token offsets (start, end)."""
    mask = np.zeros(len(offsets), bool)
    pieces: list[tuple[int, int]] = []
    if not len(spans) or not len(offsets):
        return mask, pieces
    starts, ends = offsets[:, 0], offsets[:, 1]
    first = np.searchsorted(ends, spans[:, 0], "right")  # first token that ends after the span begins
    last = np.searchsorted(starts, spans[:, 1], "left")  # first token that begins at or after its end
    for (low, high), a, b in zip(spans.tolist(), first.tolist(), last.tolist(), strict=True):
        if low == high or a >= b:
            continue
        mask[a:b] = True
        # A character of several tokens has the same offsets in each, so a piece begins where the one before ended.
        edge = np.maximum.accumulate(np.concatenate([[low], np.minimum(ends[a:b], high)]))
        begin = np.maximum(starts[a:b], edge[:-1])
        for x, y in zip(begin.tolist(), edge[1:].tolist(), strict=True):
            if x < y:
                if pieces and pieces[-1][1] == x:
                    pieces[-1] = (pieces[-1][0], y)
                else:
                    pieces.append((x, y))
    return mask, pieces


STRETCHES = "conv_id long, part int, formatted string, ids array<int>, loss array<boolean>, pieces array<array<int>>"
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("pieces", pa.list_(pa.list_(pa.int32())))]
)


def with_parts(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, part, turn, role, text): ``part`` is the stretch of its conversation that a turn is in; it ascends with turns but may skip numbers."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("role", F.lit(""))) + F.length(F.coalesce("text", F.lit("")))
    part = F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / stretch).cast("int")
    return conversations.select("conv_id", "turn", "role", "text").select("conv_id", part.alias("part"), "turn", "role", "text")


def format_chats(conversations: DataFrame, path: str | None = None, stretch_chars: int = STRETCH) -> DataFrame:
    """(conv_id, part, formatted, ids, loss, pieces) of each stretch; ``part`` gives their order within each conversation.

    ``loss`` has a mark for each token id, ``pieces`` the character spans of ``formatted`` under the mask.
    """
    path = path or default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        def stretch(conv, part: int, turns: list[tuple[str, str]]) -> tuple:
            text, spans = rendered(turns)
            coded = tokenizer.encode(text, add_special_tokens=False)
            mask, pieces = loss_mask(np.array(coded.offsets, np.int64).reshape(-1, 2), spans)
            return conv, part, text, coded.ids, mask.tolist(), [list(p) for p in pieces]

        held: list[tuple[str, str]] = []
        at = None
        for conv_id, part, role, text in rows_of(batches, "conv_id", "part", "role", "text"):
            if held and (conv_id, part) != at:
                yield stretch(*at, held)
                held = []
            at = conv_id, part
            held.append((role or "", text or ""))
        if held:
            yield stretch(*at, held)

    turns = with_parts(conversations, stretch_chars).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return turns.mapInArrow(lambda batches: batched(rows(batches), _ARROW, 64), STRETCHES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
_DIGESTS_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGESTS.split(", ")])


def digests(stretches: DataFrame) -> DataFrame:
    """One row for each conversation, from its formatted stretches alone, which are read back and hashed as a stream."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, begun = None, False

        def row() -> tuple:
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens, learnt

        for conv_id, formatted, pieces, n_ids, n_learnt in rows_of(batches, "conv_id", "formatted", "pieces", "n_ids", "n_learnt"):
            if not begun or conv_id != conv:
                if begun:
                    yield row()
                conv, begun, n, chars, size, tokens, learnt = conv_id, True, 0, 0, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text in parsed(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            under = "".join(unescaped(formatted[a:b]) for a, b in pieces)  # a piece is a whole text: adjoining parts are one
            loss.update(under.encode())
            chars += len(under)
            size += len(formatted)
            tokens += n_ids
            learnt += n_learnt
        if begun:
            yield row()

    counts = [F.size("ids").alias("n_ids"), F.size(F.filter("loss", lambda x: x)).alias("n_learnt")]  # ids and marks aren't shuffled
    ordered = stretches.select("conv_id", "part", "formatted", "pieces", *counts).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(lambda batches: batched(rows(batches), _DIGESTS_ARROW), DIGESTS)

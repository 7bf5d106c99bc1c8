"""Chat formatting by grammar round trip.

Grammar of the rendered text (fixed strings of the template)::

    conversation = { turn }
    turn         = "<s>" content "</s>"                        assistant
                 | "[INST] " name "\\n" content " [/INST]"      any other role

``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` are control strings. Where they, or their escaped
forms, stand in a role or text, a backslash is put behind their first character; the parser takes
one such backslash away. Turns begin and end in the parser's start state, so parsing turn by turn
is parsing the whole, and the round trip can be checked on each row of a conversation of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")

SEGMENTS = (
    "conv_id long, seq long, char_start long, segment string, loss_start long, loss_chars long, escaped boolean"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, content: str) -> tuple[str, int]:
    """A turn's text and where its content starts."""
    if role == "assistant":
        return f"<s>{content}</s>", 3
    head = f"[INST] {_name(role)}\n"
    return f"{head}{content} [/INST]", len(head)


def _name(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and length of the content in ``rendered``) of each turn, left to right.

    Raises ValueError where ``rendered`` isn't in the grammar.
    """
    turns, at = [], 0
    while at < len(rendered):
        if rendered.startswith("<s>", at):
            role, start, close = "assistant", at + 3, "</s>"
        elif rendered.startswith("[INST] ", at):
            line = rendered.find("\n", at)
            if line < 0:
                raise ValueError(f"a turn at {at} has no name")
            role, start, close = _role(rendered[at + 7 : line]), line + 1, " [/INST]"
        else:
            raise ValueError(f"no turn starts at {at}")
        end = rendered.find(close, start)
        if end < 0:
            raise ValueError(f"the turn at {at} isn't closed")
        if re.search(r"</?s>|\[/?INST\]", rendered[start:end]):
            raise ValueError(f"a control string stands inside the turn at {at}")
        turns.append((role, unescape(rendered[start:end]), start, end - start))
        at = end + len(close)
    return turns


def render_checked(role: str, text: str) -> tuple[str, int, int, bool]:
    """Rendered turn, content start and length, and if it had to be escaped.

    The text is rendered as it is and parsed again; while the recovered turn differs, the content
    is escaped once more. One escape is always enough; more than two would be a fault.
    """
    content = text
    for escapes in range(3):
        segment, start = render(role, content)
        try:
            found = parse(segment)
        except ValueError:
            found = []
        if [x[:2] for x in found] == [(role, text)]:
            return segment, start, len(content), escapes > 0
        content = escape(content)
    raise AssertionError("round trip failed")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, seq, at = object(), 0, 0
    for batch in batches:
        out = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != now:
                now, seq, at = conv, 0, 0
            segment, start, n, escaped = render_checked(role or "", text or "")
            loss = role == "assistant"
            out.append((conv, seq, at, segment, at + start if loss else None, n if loss else 0, escaped))
            seq, at = seq + 1, at + len(segment)
        yield _batch(out, _SEGMENT_TYPES)


_SEGMENT_TYPES = {
    "conv_id": pa.int64(), "seq": pa.int64(), "char_start": pa.int64(), "segment": pa.string(),
    "loss_start": pa.int64(), "loss_chars": pa.int64(), "escaped": pa.bool_(),
}
_DIGEST_TYPES = {
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
    "loss_sha256": pa.string(), "formatted_chars": pa.int64(),
}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text): its part of the rendered text.

    ``char_start`` is the part's place in its conversation's rendered text, ``loss_start`` and
    ``loss_chars`` the characters that training counts (assistant content). Rows of a conversation
    go in order of turn, then role and text where turns tie, nulls first; null role or text counts
    as empty; rows with a null conv_id are one conversation. Other columns are ignored. A
    conversation streams through one task in sorted (spillable) order and is never held as a whole.
    Repeated rows are turns of their own; an empty table gives no rows.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_segments, SEGMENTS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: object = batches  # no conversation
    turns = loss = None
    n = loss_chars = chars = 0
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_chars"))
        for conv, segment, start, masked in zip(*columns, strict=True):
            if conv != now or turns is None:
                if turns is not None:
                    out.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                now, n, loss_chars, chars = conv, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text, _, _ in parse(segment):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            if start is not None:  # the mask is a stretch of the conversation's text, of which ``chars`` came before
                text = unescape(segment[start - chars : start - chars + masked])
                loss.update(text.encode())
                loss_chars += len(text)
            chars += len(segment)
        yield _batch(out, _DIGEST_TYPES)
    if turns is not None:
        yield _batch([(now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)], _DIGEST_TYPES)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation as parsed from the rendered ``segments``, the loss as its mask cuts it out.

    The rows of ``format_conversations`` can be given as they come. Rows read from storage are first
    put in order again by ``in_order``.
    """
    return segments.mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def in_order(segments: DataFrame) -> DataFrame:
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

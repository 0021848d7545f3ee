"""Chat formatting: conversations rendered by a template that is taken as a black box.

A template is a function from turns to text. Successive prefixes of a conversation are rendered
and consecutive outputs compared: what a longer prefix adds is the last turn's span, and where
it doesn't begin with the shorter one's output the template rewrites history, which is reported
in characters. Where a turn's text lies inside its span is found by rendering the prefix once more with a
stand-in for the text. Nothing but this is assumed of a template.

Rendering all prefixes of n turns costs the square of n. A template that looks back no further
than ``lead`` turns is rendered in blocks instead, each behind the ``lead`` turns before it, so
time grows with the turns and a task keeps one block, whatever a conversation's length;
``lead=None`` renders whole conversations, each held by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns and characters of a block.
TURNS, CHARS = 8, 1 << 18
#: Characters of a batch of results.
BATCH = 1 << 21
Turn = tuple[str, str]

# Control strings of widespread chat templates. None holds another's first letter behind its own.
CONTROLS = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")


class Escape:
    """Control strings inside texts, made harmless and back: one more backslash behind the first letter of each, however many
    there are, so that no text is turned into another's escape."""

    def __init__(self, controls: Iterable[str] = CONTROLS) -> None:
        controls = tuple(controls)
        first = {c[0] for c in controls}
        for c in controls:
            if len(c) < 2 or "\\" in c or first & set(c[1:]):
                raise ValueError(f"{c!r} can't be escaped")
        forms = lambda slashes: "|".join(f"{re.escape(c[0])}{slashes}{re.escape(c[1:])}" for c in controls)
        self.plain, self.escaped = re.compile(forms(r"\\*")), re.compile(forms(r"\\+"))

    def on(self, text: str) -> str:
        return self.plain.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def off(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0] + m[0][2:], text)


class Template:
    """``<|turn|>role``, a new line, the text, ``<|end|>`` and a new line for each turn; role and text are escaped."""

    def __init__(self, escape: Escape | None = None) -> None:
        self.escape = escape or Escape()

    def render(self, turns: list[Turn]) -> str:
        return "".join(f"<|turn|>{self.escape.on(_one_line(role))}\n{self.escape.on(text)}<|end|>\n" for role, text in turns)

    def read(self, span: str) -> Turn:
        """The turn that a span was rendered from."""
        head, _, rest = span.partition("\n")
        if not (head.startswith("<|turn|>") and rest.endswith("<|end|>\n")):
            raise ValueError(f"no turn: {span[:80]!r}")
        return _many_lines(self.escape.off(head.removeprefix("<|turn|>"))), self.escape.off(rest.removesuffix("<|end|>\n"))


def _one_line(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _many_lines(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass(frozen=True)
class Span:
    """A turn in the output: its part of the text, where that begins, where the turn's own text lies (None: not to be told),
    and how many characters of the earlier output its rendering changed."""

    role: str
    piece: str
    start: int
    body: tuple[int, int] | None
    rewrites: int


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def block_spans(render: Callable[[list[Turn]], str], before: list[Turn], block: list[Turn]) -> tuple[list[tuple[str, tuple[int, int] | None, int]], int]:
    """(piece, body inside the piece, rewrites) of each turn of a block behind the turns before it, and how much of their output changed.

    The pieces together are the last output behind that of the turns before: a turn ends where no later prefix changes the output any more.
    """
    out = first = render(before) if before else ""
    ends, bodies, rewrites = [], [], []
    for k, (role, _) in enumerate(block):
        turns = before + block[:k]
        mark = next(chr(c) for c in range(0xE000, 0xF900) if chr(c) not in role)  # a private-use character stands in for the text
        told, longer = render([*turns, (role, mark)]), render([*turns, block[k]])
        common = _common(out, longer)
        ends.append(common)  # of what lies before this turn
        rewrites.append(len(out) - common)
        head, _, tail = told[common:].partition(mark)
        added = longer[common:]
        sound = told[:common] == out[:common] and told[common:].count(mark) == 1 and added.startswith(head) and added.endswith(tail) and len(head) + len(tail) <= len(added)
        bodies.append((common + len(head), len(longer) - len(tail)) if sound else None)
        out = longer
    ends.append(len(out))
    for k in range(len(block) - 1, -1, -1):
        ends[k] = min(ends[k], ends[k + 1])
    made = []
    for k, body in enumerate(bodies):
        if body is not None:  # a later prefix may have changed it
            body = (body[0] - ends[k], body[1] - ends[k]) if body[1] <= ends[k + 1] else None
        made.append((out[ends[k] : ends[k + 1]], body, rewrites[k]))
    return made, len(first) - ends[0] if block else 0


def spans(render: Callable[[list[Turn]], str], turns: Iterable[Turn], lead: int | None = 1, most_turns: int = TURNS, most_chars: int = CHARS) -> Iterator[Span]:
    """The spans of one conversation, in order. With a ``lead``, a template that changes what lies before a block is an error."""
    before: list[Turn] = []
    block: list[Turn] = []
    chars = at = 0

    def done() -> Iterator[Span]:
        nonlocal at
        made, changed = block_spans(render, before, block)
        if changed:
            raise ValueError("the template rewrites turns before a block: render whole conversations, lead=None")
        for (role, _), (piece, body, rewrites) in zip(block, made, strict=True):
            yield Span(role, piece, at, body and (at + body[0], at + body[1]), rewrites)
            at += len(piece)

    for turn in turns:
        block.append(turn)
        chars += len(turn[1])
        if lead is not None and (len(block) >= most_turns or chars >= most_chars):
            yield from done()
            before, block, chars = (before + block)[-lead:] if lead else [], [], 0
    if block:
        yield from done()


_SPANS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("body_start", pa.int64()), ("body_end", pa.int64()), ("loss", pa.bool_()), ("rewrites", pa.int64())])
_SPANS_SQL = "conv_id bigint, place bigint, role string, piece string, start bigint, end bigint, body_start bigint, body_end bigint, loss boolean, rewrites bigint"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its rows) of sorted batches; the rows of one must be taken before the next is asked for."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held = next(rows, None)
    while held is not None:
        conv = held[0]

        def own() -> Iterator[tuple]:
            nonlocal held
            while held is not None and held[0] == conv:
                now, held = held, None
                yield now
                held = next(rows, None)

        yield conv, own()


def format_conversations(df: DataFrame, render: Callable[[list[Turn]], str], lead: int | None = 1, learn: tuple[str, ...] = ("assistant",), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, piece, start, end, body_start, body_end, loss, rewrites): a row for each row of df.

    A conversation's pieces in order of place are its formatted text; start to end is where a piece
    lies in it and body_start to body_end where the turn's own text does, in code points (null where it isn't to be told); loss says
    that this text is learned, by its role; rewrites counts the characters of the earlier output that rendering the
    turn changed, 0 for a template that only appends.

    Rows stand by turn, null turns first, ties by role and text, so repeated rows stand together. Null roles and texts
    are empty; rows without a conv_id are one conversation; an empty table gives no row; other columns are not read.
    Rows are dealt by conversation and stream in order through a task, which keeps one block of them with a lead.
    """
    words = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias
    rows = df.select(F.col(f"`{conv_id}`").cast("bigint").alias("c"), F.col(f"`{turn}`").alias("n"), words(role)("r"), words(text)("t"))
    rows = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for conv, turns in _conversations(batches):
            for place, s in enumerate(spans(render, ((r, t) for _, r, t in turns), lead)):
                out.append((conv, place, s.role, s.piece, s.start, s.start + len(s.piece), s.body and s.body[0], s.body and s.body[1], s.role in learn, s.rewrites))
                chars += len(s.piece) + 100
                if chars > BATCH:
                    yield _batch(out, _SPANS)
                    out, chars = [], 0
        yield _batch(out, _SPANS)

    return rows.mapInArrow(formatted, _SPANS_SQL)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten_chars", pa.int64())])
_READ_SQL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewritten_chars bigint"


def read_back(formatted: DataFrame, template: Template) -> DataFrame:
    """What the formatted text itself says, a row for each conversation: its number of turns, the digest of role, new line, text,
    new line of each, the characters and the digest of all text under the loss mask, its characters, and those rewritten.

    ``formatted`` comes straight from format_conversations, whose order it keeps. Only pieces, masks and their places are read, not the roles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, rows in _conversations(batches):
            turns, learned = hashlib.sha256(), hashlib.sha256()
            n = chars = end = rewritten = 0
            for _, _, _, piece, start, end, a, b, loss, rewrites in rows:
                role, text = template.read(piece)
                turns.update(f"{role}\n{text}\n".encode())
                if loss and a is not None:
                    body = template.escape.off(piece[a - start : b - start])
                    learned.update(body.encode())
                    chars += len(body)
                n += 1
                rewritten += rewrites
            out.append((conv, n, turns.hexdigest(), chars, learned.hexdigest(), end, rewritten))
            if len(out) >= 4096:
                yield _batch(out, _READ)
                out = []
        yield _batch(out, _READ)

    return formatted.mapInArrow(read, _READ_SQL)

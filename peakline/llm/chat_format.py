"""Chat formatting by incremental rendering of a black-box template.

A template is only a function from turns to text. Successive turn prefixes are rendered and consecutive outputs compared: where an output
continues the one before, the new part is the span of the new turn. Where it does not, the template rewrites history. Inside a span the text of a turn is
found by rendering the prefix with two probe texts in its place, which differ from each other exactly where the text stands. Spans of assistant texts
are the loss mask.

Conversations are cut into segments by turn number, so a conversation of any length is spread over tasks; a segment is rendered behind the turn before it,
which is all that a *local* template may look at. A template that is not local is given whole conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from peakline.llm.common import in_arrow, key_of, stored, whole_text
from peakline.operators.chunks import bucket_prefix

Turn = tuple[str, str]

#: Turn numbers of one segment, and the most turns and characters rendered together.
SEGMENT, SEGMENT_CHARS = 32, 1_000_000
#: Two texts that differ in all characters.
PROBES = ("q", "z")
_NUMBERED = "segment long, part int, text string, turns array<struct<start:int,end:int,text_start:int,text_end:int,loss:boolean,rewritten:boolean>>"


@dataclass(frozen=True)
class Template:
    """render: turns to text; parse and unescape: read turns and texts back; local: a turn's rendering depends on nothing but the turn, the
    one before it and whether there is one; trained: roles whose texts are under the loss mask."""

    render: Callable[[Sequence[Turn]], str]
    parse: Callable[[str], list[Turn]]
    unescape: Callable[[str], str]
    local: bool = True
    trained: frozenset[str] = field(default_factory=lambda: frozenset({"assistant"}))


# The instruction template --------------------------------------------------------------------------------------------

#: Control strings of the instruction template. Fixed by the format.
OPEN, END, USER, USER_END = "<s>", "</s>", "[INST]", "[/INST]"
#: Marks of this library for other roles.
SYSTEM, SYSTEM_END, ROLE, ROLE_TEXT, ROLE_END = "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]"
CONTROLS = (OPEN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_TEXT, ROLE_END)
_CONTROL = re.compile("|".join(map(re.escape, (*CONTROLS, "\\"))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """A backslash goes behind the first character of every control string and in front of every backslash."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _render(turns: Sequence[Turn]) -> str:
    out = [OPEN] if turns else []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            out += (USER, " ", text, " ", USER_END)
        elif role == "assistant":
            out += (" ", text, END)
        elif role == "system":
            out += (SYSTEM, " ", text, " ", SYSTEM_END)
        else:
            out += (ROLE, " ", escape(role), " ", ROLE_TEXT, " ", text, " ", ROLE_END)
    return "".join(out)


def _parse(text: str) -> list[Turn]:
    """Turns of a formatted text, or of a piece of it that begins and ends between turns. Escaped texts hold no control string, so
    the next one is the mark."""
    out, at = [], len(OPEN) if text.startswith(OPEN) else 0
    while at < len(text):
        for mark, end, role in ((USER, USER_END, "user"), (SYSTEM, SYSTEM_END, "system"), (ROLE, ROLE_END, None)):
            if text.startswith(mark, at):
                stop = text.index(end, at)
                body = text[at + len(mark) + 1:stop - 1]
                if role is None:
                    role, _, body = body.partition(f" {ROLE_TEXT} ")
                    role = unescape(role)
                break
        else:
            end, role = END, "assistant"
            stop = text.index(end, at)
            body = text[at + 1:stop]
        out.append((role, unescape(body)))
        at = stop + len(end)
    return out


INSTRUCTION = Template(_render, _parse, unescape)


# Locating turns ------------------------------------------------------------------------------------------------------

def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def text_span(template: Template, turns: Sequence[Turn], at: int, rendered: str) -> tuple[int, int] | None:
    """Where the text of turn `at` stands in the rendering of `turns`; None if it does not stand there as one piece that unescapes to it."""
    role, text = turns[at]
    one, two = (template.render([*turns[:at], (role, probe), *turns[at + 1:]]) for probe in PROBES)
    if one == two:
        return None  # the template leaves the text out
    head = _common_prefix(one, two)
    tail = len(one) - head - len(PROBES[0])
    start, end = head, len(rendered) - tail
    return (start, end) if 0 <= tail and start <= end and template.unescape(rendered[start:end]) == text else None


@dataclass
class Located:
    """The rendering of turns behind a context, and per turn: span, span of its text (None if altered), and whether it rewrote history."""

    text: str
    spans: list[tuple[int, int]]
    texts: list[tuple[int, int] | None]
    rewritten: list[bool]


def locate(template: Template, context: Sequence[Turn], turns: Sequence[Turn]) -> Located:
    """Renders successive prefixes of `turns` behind `context`. Offsets count from the end of the context.

    If an output does not continue the one before, that turn rewrites history: what the last output holds decides, and the texts of all turns are looked up there again;
    spans then begin where outputs part.
    """
    seen = list(context)
    before = template.render(seen) if seen else ""
    base = len(before)
    spans, texts, rewritten = [], [], []
    for turn in turns:
        seen.append(turn)
        now = template.render(seen)
        kept = _common_prefix(before, now)
        rewritten.append(kept < len(before))
        spans.append((kept, len(now)))
        texts.append(None if any(rewritten) else text_span(template, seen, len(seen) - 1, now))
        before = now
    if any(rewritten):
        texts = [text_span(template, seen, at, before) for at in range(len(context), len(seen))]
    shift = lambda span: span and (max(span[0] - base, 0), max(span[1] - base, 0))
    return Located(before[base:], [shift(x) for x in spans], [shift(x) for x in texts], rewritten)


# The tables ----------------------------------------------------------------------------------------------------------

def format_conversations(turns: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """(conv_id, segment, part, text, turns) of every conversation; texts of equal conv_id, in order of segment and part, make up its output.

    `turns` holds conv_id, turn, role, text. Turns are ordered by turn (null last), then role and text, so ties and repeated rows have a fixed order; each row is one turn. A
    null text or role counts as empty, a null conv_id is a conversation of its own; other columns are ignored whatever their names, an empty table gives an empty result.
    The column `turns` has per turn its span and that of its text in code points of the row's text (null if the template altered the text), whether the text is under the loss mask,
    and whether the turn rewrote history. A local template that rewrites history is an error: it was declared wrongly.
    """
    segment = F.when(F.col("turn").isNull(), F.lit(1 << 60)).otherwise(F.floor(F.col("turn") / F.lit(SEGMENT))).cast("long") if template.local else F.lit(0).cast("long")
    rows = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), whole_text().alias("text"))
            .withColumn("key", key_of(F.col("conv_id"))).withColumn("segment", segment))
    dealt = rows.withColumn("ahead", F.lit(False))
    if template.local:
        # The last turn before every segment that is not the first of its conversation; few conversations have more than one.
        parts = rows.groupBy("key", "segment").agg(F.count("*").alias("n"))
        earlier = bucket_prefix(parts.withColumn("own", F.col("segment")), ["key"], "segment", "own", "last", "earlier")
        earlier = earlier.filter("earlier IS NOT NULL").select("key", F.col("segment").alias("to"), F.col("earlier").alias("segment"))
        order = F.struct(F.col("turn").isNull(), "turn", "role", "text")
        last = rows.join(earlier, ["key", "segment"]).groupBy("key", "to").agg(F.max(F.struct(order.alias("order"), "conv_id")).alias("last"))
        dealt = dealt.unionByName(last.select("last.conv_id", "last.order.turn", "last.order.role", "last.order.text", "key", F.col("to").alias("segment"), F.lit(True).alias("ahead")))
    order = ["key", "segment", F.col("ahead").desc(), F.col("turn").asc_nulls_last(), "role", "text"]
    spread = dealt.repartition("key", "segment").sortWithinPartitions(*order).select("conv_id", "segment", "role", "text", "ahead")
    return spread.transform(in_arrow, lambda batches: _formatted(batches, template), f"conv_id long, {_NUMBERED}")


def _formatted(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Rows arrive in order; a segment with very many or very long turns is handed over in several parts."""
    place: tuple | None = None
    part, size = 0, 0
    context: list[Turn] = []
    turns: list[Turn] = []
    out: list[tuple] = []
    held = 0

    def close() -> None:
        nonlocal context, turns, part, size, held
        if not turns:
            return
        found = locate(template, context, turns)
        if template.local and any(found.rewritten):
            raise ValueError("the template rewrites earlier turns, so it is not local")
        marks = [{"start": a, "end": b, "text_start": t and t[0], "text_end": t and t[1], "loss": t is not None and role in template.trained, "rewritten": r}
                 for (a, b), t, r, (role, _) in zip(found.spans, found.texts, found.rewritten, turns, strict=True)]
        out.append((*place, part, found.text, marks))
        held += len(found.text)
        context, turns, part, size = turns[-1:], [], part + 1, 0

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "role", "text", "ahead"))
        for conv, segment, role, text, ahead in zip(*columns, strict=True):
            if (conv, segment) != place:
                close()
                place, part, context = (conv, segment), 0, []
            if ahead:
                context = [(role, text)]
                continue
            turns.append((role, text))
            size += len(text)
            if template.local and (len(turns) >= SEGMENT or size >= SEGMENT_CHARS):
                close()
        if held >= SEGMENT_CHARS:
            yield _rows(out)
            out, held = [], 0
    close()
    if out:
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    marks = pa.list_(pa.struct([(name, pa.int32()) for name in ("start", "end", "text_start", "text_end")] + [("loss", pa.bool_()), ("rewritten", pa.bool_())]))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), marks]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "segment", "part", "text", "turns"])


def read_back(formatted: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the output alone.

    Roles and texts are parsed from it; the text under the loss mask is cut out by its spans and unescaped. A digest goes over a conversation in order,
    so its parts stream through one task, one at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, started = None, False
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

        def row() -> tuple:
            return conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        for batch in batches:
            for id_, text, marks in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "turns")), strict=True):
                if started and id_ != conv:
                    out.append(row())
                    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                conv, started = id_, True
                for role, body in template.parse(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    counts[0] += 1
                for mark in marks:
                    if mark["loss"]:
                        body = template.unescape(text[mark["text_start"]:mark["text_end"]])
                        loss.update(body.encode())
                        counts[1] += len(body)
                counts[2] += len(text)
            if len(out) > 4096:
                yield _digests(out)
                out = []
        if started:
            out.append(row())
        if out:
            yield _digests(out)

    ordered = formatted.repartition(key_of(F.col("conv_id"))).sortWithinPartitions("conv_id", "segment", "part").select("conv_id", "text", "turns")
    return ordered.transform(in_arrow, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def round_trip(turns: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """Formats, writes, and reads back."""
    return read_back(stored(format_conversations(turns, template)), template)


def sql(extra: str, source: str = "conversations") -> str:
    """The same rows in DuckDB's SQL; `extra` lists further rows (conv_id, turn, role, text)."""
    escaped = lambda column: "len(replace({}, '\\', '\\\\')){}".format(column, "".join(f" + (len({column}) - len(replace({column}, '{c}', ''))) // {len(c)}" for c in CONTROLS))
    marks = (f"CASE role WHEN 'user' THEN {len(USER) + len(USER_END) + 2} WHEN 'assistant' THEN {len(END) + 1} WHEN 'system' THEN {len(SYSTEM) + len(SYSTEM_END) + 2} "
             f"ELSE {len(ROLE) + len(ROLE_TEXT) + len(ROLE_END) + 4} + {escaped('role')} END")
    order = "ORDER BY turn NULLS LAST, role, text"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM {source} UNION ALL {extra}) AS u(conv_id, turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
       ({len(OPEN)} + sum({escaped('text')} + {marks}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

"""Fill-in-the-middle: a text is cut twice and its parts are rearranged around sentinels, so that the middle comes last.

Cuts are ranks of units: code points, or the matches of a pattern (words, lines). An indexable skip list over the units finds where a rank
lies: every node of every lane carries how many units, code points and bytes it spans, and a search goes along the highest lane while the
accumulated units do not pass the rank, then one lane down. It ends at the cut with its exact offsets in code points and in bytes, so the UTF-8
text is cut without being decoded.

What happens to a document follows from its id alone, so a lost task gives the same rows again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from peakline.llm.common import in_arrow, whole_text
from peakline.llm.hashing import mixed

#: One node in so many is promoted to the next lane, on average.
FAN = 16
#: Bytes of output that a task holds before it hands them over.
BATCH_BYTES = 8_000_000


@dataclass(frozen=True)
class Format:
    """Sentinels, the percentage of documents that are rearranged, the percentage of these with the suffix first, the seed
    of all draws, and the pattern whose matches are the units (None: code points)."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    share: int = 90
    suffix_first: int = 20
    seed: int = 1
    unit: str | None = None

    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first digits of the SHA-256 of `seed:id`. A null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def unit_starts(raw: bytes, unit: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of a UTF-8 text begin, in code points and in bytes, with the ends of the text as last entries. What lies before the first
    match belongs to the first unit, what lies between two matches to the one before."""
    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    points = np.append(lead, len(raw))  # the byte at which every code point begins
    if unit is None:
        return np.arange(len(points)), points
    at = np.array([m.start() for m in re.finditer(unit, raw.decode())], np.int64)
    if len(at):
        at[0] = 0
    at = np.append(at, len(lead))
    return at, points[at]


class SkipList:
    """Indexable skip list over the units of a text. `lanes[0]` holds every unit; lane k + 1 the promoted nodes of lane k. A lane is
    (down, units, points, bytes): the node's place in the lane below, and the widths from the node to the next one of its lane."""

    def __init__(self, points: np.ndarray, bytes_: np.ndarray):
        self.n = len(points) - 1
        height = mixed(np.arange(self.n, dtype=np.uint64) + np.uint64(1))
        node = np.arange(self.n)
        self.lanes = [self._lane(node, node, points, bytes_)]
        shift = 0
        while len(node) > FAN:
            up = (height[node] >> np.uint64(shift)) % np.uint64(FAN) == 0
            up[0] = True  # the first node is the head of every lane
            down = np.flatnonzero(up)
            if len(down) == len(node):
                break
            node = node[down]
            self.lanes.append(self._lane(down, node, points, bytes_))
            shift += 4

    def _lane(self, down: np.ndarray, node: np.ndarray, points: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, ...]:
        to = np.append(node[1:], self.n)
        return down, to - node, points[to] - points[node], bytes_[to] - bytes_[node]

    def seek(self, rank: int) -> tuple[int, int]:
        """Offset of the first `rank` units, in code points and in bytes."""
        at = seen = points = bytes_ = 0
        for down, unit_width, point_width, byte_width in reversed(self.lanes):
            last = len(down)
            while at < last and seen + unit_width[at] <= rank:
                seen += int(unit_width[at])
                points += int(point_width[at])
                bytes_ += int(byte_width[at])
                at += 1
            if seen == rank:
                break
            at = int(down[at])
        return points, bytes_


def rearranged(text: str | None, doc_id: int | None, form: Format) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, UTF-8 output) of one text."""
    text = text or ""
    raw = text.encode()
    h1, h2, h3, h4 = draws(form.seed, doc_id)
    points, bytes_ = unit_starts(raw, form.unit)
    n = len(points) - 1
    if not n or any(s in text for s in form.sentinels()) or h3 % 100 >= form.share:
        return n, "plain", None, None, raw
    units = SkipList(points, bytes_)
    (p1, b1), (p2, b2) = (units.seek(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = (x.encode() for x in form.sentinels())
    prefix, middle, suffix = raw[:b1], raw[b1:b2], raw[b2:]
    if h4 % 100 < form.suffix_first:
        return n, "spm", p1, p2 - p1, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", p1, p2 - p1, b"".join((p, prefix, s, suffix, m, middle))


def fill_middle(docs: DataFrame, form: Format = Format(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row.

    n counts units. `form` is plain (output equals the text; both counts null), psm (prefix, suffix, middle) or spm (suffix, prefix, middle). A null
    or empty text, a text without units and one that holds a sentinel stay plain; a null id is drawn for like any other id. Repeated rows give repeated
    results, texts of any length are cut whole, columns besides id and text are ignored whatever their names, an empty table gives an empty result.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            texts = batch.column("text")
            for at, doc in enumerate(batch.column("doc_id").to_pylist()):
                rows.append((doc, *rearranged(texts[at].as_py(), doc, form)))
                held += len(rows[-1][-1])
                if held >= BATCH_BYTES:
                    yield _table(rows, names, types)
                    rows, held = [], 0
            if rows:
                yield _table(rows, names, types)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return narrow.transform(in_arrow, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, t) for c, t in zip(columns[:-1], types[:-1], strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[-1], pa.binary()).cast(pa.string())], names=names)


def restored(form: Format = Format(), output: str = "output", kind: str = "form") -> Column:
    """The text from output and form alone. Parts hold no sentinel, and no sentinel begins inside another, so the first
    occurrences are the marks."""
    p, s, m = form.sentinels()
    out = F.col(output)

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        a, b = F.locate(second, out), F.locate(m, out)
        one = F.substring(out, F.lit(len(first) + 1), a - len(first) - 1)
        two = F.substring(out, a + len(second), b - a - len(second))
        return one, two, F.substring(out, b + len(m), F.length(out))

    prefix, suffix, middle = between(p, s)
    suffix_, prefix_, middle_ = between(s, p)
    return F.when(F.col(kind) == "psm", F.concat(prefix, middle, suffix)).when(F.col(kind) == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(out)


def digests(docs: DataFrame, form: Format = Format()) -> DataFrame:
    """Counts and form of every document with digests of its output and of the text restored from it."""
    digest = lambda column: F.sha2(F.encode(column, "UTF-8"), 256)
    made = fill_middle(docs, form)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(form)).alias("restored_sha256"))


def sql(form: Format = Format(), source: str = "documents") -> str:
    """The same rows in DuckDB's SQL, for code points as units."""
    p, s, m = form.sentinels()
    number = lambda k: f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{form.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {source}),
k AS (SELECT doc_id, t, length(t) AS n, {number(0)} % (length(t) + 1) AS c1, {number(1)} % (length(t) + 1) AS c2,
      CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR {number(2)} % 100 >= {form.share} THEN 'plain'
           WHEN {number(3)} % 100 < {form.suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT doc_id, t, n, form, least(c1, c2) AS a, greatest(c1, c2) AS b FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || substr(t, 1, a) || '{s}' || substr(t, b + 1) || '{m}' || substr(t, a + 1, b - a)
      ELSE '{s}' || substr(t, b + 1) || '{p}' || substr(t, 1, a) || '{m}' || substr(t, a + 1, b - a) END AS output FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""

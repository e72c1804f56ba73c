"""Periodic runs of words, found by recompression.

The words of many texts are one sequence of symbols, texts set apart by symbols that occur once. Recompression makes a run-length grammar of it: rounds
alternate between block compression (a symbol repeated k times in a row becomes one symbol) and pair compression (symbols are split in two halves,
and every left one followed by a right one becomes one symbol with it), until one symbol is left. Which symbols are joined depends on the symbols alone, so equal
stretches are parsed alike but for their edges, and the longest common extension of two places is found by climbing both parses to the first
difference and going down again: a few steps per level, for all pairs of places at once.

A run of period q in which q-spaced words are equal over a stretch of m words has a multiple of m (and of any smaller number) in that stretch. So for
every period only each m-th place is a candidate, m being the shortest stretch that counts; there are O(n log n) candidates in all, and the two extensions of a candidate are the exact run. No suffix array
is built.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from peakline.llm.common import in_arrow, whole_text
from peakline.llm.hashing import mixed

#: Words whose texts share one grammar; a longer text has one of its own.
BATCH_WORDS = 200_000
#: Candidates whose extensions are looked up together.
BATCH_CANDIDATES = 1 << 17
#: Least repetitions of a run and least words.
EXPONENT, LEAST = 4, 6


@dataclass
class Level:
    """Symbols of a level, the parent of each in the next level, and where the children of each parent begin (with the end). In a
    block level parents are whole blocks, otherwise pairs or single symbols."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    blocks: bool


class Grammar:
    """Run-length grammar of a sequence of symbols below `names`. The first and the last symbol must occur nowhere else."""

    def __init__(self, sequence: np.ndarray, names: int):
        self.n = len(sequence)
        self.levels: list[Level] = []
        symbols, round_ = sequence.astype(np.int64), 0
        while len(symbols) > 1:
            symbols, names = self._blocks(symbols, names)
            if len(symbols) > 1:
                symbols, names = self._pairs(symbols, names, round_)
            round_ += 1
        self.levels.append(Level(symbols, np.zeros(len(symbols), np.int64), np.arange(len(symbols) + 1), True))

    def _climb(self, symbols: np.ndarray, begins: np.ndarray, blocks: bool) -> np.ndarray:
        """Keeps a level; returns where its parents begin."""
        at = np.flatnonzero(begins)
        self.levels.append(Level(symbols, np.cumsum(begins) - 1, np.append(at, len(symbols)), blocks))
        return at

    def _blocks(self, symbols: np.ndarray, names: int) -> tuple[np.ndarray, int]:
        begins = np.ones(len(symbols), bool)
        begins[1:] = symbols[1:] != symbols[:-1]
        if begins.all():
            return symbols, names
        at = self._climb(symbols, begins, True)
        length = np.diff(np.append(at, len(symbols)))
        out = symbols[at]
        long = np.flatnonzero(length > 1)
        out[long], names = _named(out[long], length[long], names)
        return out, names

    def _pairs(self, symbols: np.ndarray, names: int, round_: int) -> tuple[np.ndarray, int]:
        side = (mixed(symbols.astype(np.uint64) * np.uint64(2) + np.uint64(2 * round_ + 1)) & np.uint64(1)).astype(bool)
        one, other = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
        joined = one if np.count_nonzero(one) >= np.count_nonzero(other) else other
        if not joined.any():
            return symbols, names
        begins = np.ones(len(symbols), bool)
        begins[1:] = ~joined
        at = self._climb(symbols, begins, False)
        out = symbols[at]
        wide = np.flatnonzero(np.diff(np.append(at, len(symbols))) > 1)
        out[wide], names = _named(symbols[at[wide]], symbols[at[wide] + 1], names)
        return out, names

    def extend(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols from a and b on (a < b, these included) are equal, going forward or backward."""
        step = 1 if forward else -1
        high_a, high_b = a.copy(), b.copy()
        where = np.zeros(len(a), np.int64)  # level at which the parses differ
        open_ = np.arange(len(a))
        for depth, level in enumerate(self.levels):
            x, y = high_a[open_], high_b[open_]
            x, y, equal, apart = self._pass(level, x, y, forward)
            # Parses that agree so far are at the edges of parents unless two blocks of one symbol differ in length.
            high_a[open_], high_b[open_] = x, y
            where[open_[apart]] = depth
            open_ = open_[~apart]
            if not len(open_):
                break
            high_a[open_], high_b[open_] = level.parent[high_a[open_]], level.parent[high_b[open_]]
        order = np.argsort(-where, kind="stable")
        heights = where[order]
        for depth in range(int(heights[0]) if len(heights) else 0, 0, -1):
            down = order[:np.searchsorted(-heights, -depth, "right")]
            level = self.levels[depth - 1]
            x, y = high_a[down], high_b[down]
            x, y = (level.first[x], level.first[y]) if forward else (level.first[x + 1] - 1, level.first[y + 1] - 1)
            same = level.symbols[x] == level.symbols[y]
            skip = np.where(same, np.minimum(_left(level, x, forward), _left(level, y, forward)) if level.blocks else 1, 0)
            high_a[down], high_b[down] = x + step * skip, y + step * skip
        return (high_a - a) * step

    @staticmethod
    def _pass(level: Level, x: np.ndarray, y: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Goes on in a level until both places are at the edge of a parent (`apart` false) or differ (true)."""
        inside_x, inside_y = _left(level, x, forward), _left(level, y, forward)
        whole_x, whole_y = (level.first[level.parent[p] + 1] - level.first[level.parent[p]] for p in (x, y))
        edge = (inside_x == whole_x) & (inside_y == whole_y)
        equal = level.symbols[x] == level.symbols[y]
        skip = np.where(~edge & equal, np.minimum(inside_x, inside_y) if level.blocks else 1, 0) * (1 if forward else -1)
        apart = ~edge & (~equal | ((inside_x != inside_y) if level.blocks else False))
        return x + skip, y + skip, equal, apart


def _left(level: Level, at: np.ndarray, forward: bool) -> np.ndarray:
    """Children of its parent from `at` on, itself included."""
    parent = level.parent[at]
    return level.first[parent + 1] - at if forward else at - level.first[parent] + 1


def _named(left: np.ndarray, right: np.ndarray, names: int) -> tuple[np.ndarray, int]:
    """New symbols for pairs of numbers, equal for equal pairs."""
    _, name = np.unique(left * np.int64(1 << 31) + right, return_inverse=True)
    return names + name, names + (int(name.max()) + 1 if len(name) else 0)


def shortest_stretch(period: int, exponent: int = EXPONENT, least: int = LEAST) -> int:
    """Least number of words in a row that equal the word one period on, in a run that counts."""
    return max(least, exponent * period) - period


def find_runs(sequence: np.ndarray, lengths: np.ndarray, names: int, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs in texts of `lengths` that follow each other in `sequence`, each behind a symbol of its own and the
    last one before one more. Longer texts come first. Symbols are below `names`. Sorted by start, then period."""
    found: list[np.ndarray] = []
    grammar: Grammar | None = None
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle() -> None:
        nonlocal grammar, waiting, held
        if not waiting:
            return
        grammar = grammar or Grammar(sequence, names)
        at, period = (np.concatenate(c) for c in zip(*waiting, strict=True))
        ahead = grammar.extend(at, at + period, True)
        back = grammar.extend(at, at + period, False) - 1
        length = ahead + back + period
        enough = length >= np.maximum(least, exponent * period)
        found.append(np.unique(np.stack([(at - back)[enough], length[enough], period[enough]], axis=1), axis=0))
        waiting, held = [], 0

    ends = np.cumsum(lengths + 1)  # of texts, each with the symbol before it
    longest = int(lengths[0]) if len(lengths) else 0
    for period in range(1, longest // exponent + 1):
        texts = np.searchsorted(-lengths, -max(least, exponent * period), "right")  # only texts long enough
        if not texts:
            break
        at = np.arange(0, ends[texts - 1] - period, shortest_stretch(period, exponent, least))
        at = at[sequence[at] == sequence[at + period]]
        if len(at):
            waiting.append((at, np.full(len(at), period)))
            held += len(at)
            if held >= BATCH_CANDIDATES:
                settle()
    settle()
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    # A stretch that has a period has its multiples too; the smallest counts.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_texts(words: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of every text; texts are arrays of word numbers from one numbering."""
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    lengths = np.array([len(words[k]) for k in order], np.int64)
    names = max((int(w.max()) + 1 for w in words if len(w)), default=0)
    parts: list[np.ndarray] = []
    for k, text in enumerate(order):
        parts += (np.array([names + k], np.int64), words[text].astype(np.int64))
    sequence = np.concatenate([*parts, np.array([names + len(order)], np.int64)])
    rows = find_runs(sequence, lengths, names + len(order) + 1, exponent, least)
    begin = np.cumsum(lengths + 1) - lengths
    cuts = np.searchsorted(rows[:, 0], np.append(begin, len(sequence)))
    out = [np.zeros((0, 3), np.int64)] * len(words)
    for k, text in enumerate(order):
        mine = rows[cuts[k]:cuts[k + 1]].copy()
        mine[:, 0] -= begin[k]
        out[text] = mine
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: all but those behind the first period of a run."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(turns[:n]) == 0


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten: the places of the words that a text of n words has after its tail was made periodic; None for the others. A null
    id counts as no digits."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


def collapse(docs: DataFrame, edit: Callable[[int | None, int], np.ndarray | None] | None = None, exponent: int = EXPONENT, least: int = LEAST, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs as (start, length, period), counted in words from 0 and ordered by start and
    period, and its words without those behind the first period of a run, joined by one space.

    A run is a maximal stretch with smallest period q of at least `exponent` periods and `least` words. `edit` may give the places from which the words are taken, by id and number of
    words. A null or empty text, and one of white space, has no words, no runs and collapses to nothing. Repeated rows give repeated results, texts of any length are
    searched whole, other columns are ignored whatever their names, an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            at = 0
            while at < len(ids):
                docs_, places, count, begin = [], [], 0, at
                while at < len(ids) and (at == begin or count < BATCH_WORDS):
                    words = texts[at].as_py().encode().split()  # bytes are split at ASCII white space only
                    docs_.append(words)
                    places.append(edit(ids[at], len(words)) if edit else None)
                    count += len(words)
                    at += 1
                yield _collapsed(ids[begin:at], docs_, places, exponent, least)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return narrow.transform(in_arrow, run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _collapsed(ids: list, docs: list[list[bytes]], places: list, exponent: int, least: int) -> pa.RecordBatch:
    sizes = np.array(list(map(len, docs)), np.int64)
    flat = pa.array([w for words in docs for w in words], pa.binary()).dictionary_encode()
    numbers = np.split(flat.indices.to_numpy(), np.cumsum(sizes)[:-1])
    numbers = [x if p is None else x[p] for x, p in zip(numbers, places, strict=True)]
    runs = runs_of_texts(numbers, exponent, least)
    texts = []
    for words, place, mine in zip(docs, places, runs, strict=True):
        if len(mine):
            at = np.flatnonzero(kept_words(len(words), mine))
            words = [words[i] for i in (at if place is None else place[at]).tolist()]
        elif place is not None:
            words = [words[i] for i in place.tolist()]
        texts.append(b" ".join(words))
    all_ = np.concatenate(runs)
    struct = pa.StructArray.from_arrays([pa.array(all_[:, k].copy()) for k in range(3)], names=["start", "length", "period"])
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(offsets, struct), pa.array(texts, pa.binary()).cast(pa.string())],
                                      names=["doc_id", "n_words", "runs", "collapsed"])


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest run (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    longest = F.array_max(ranked)
    line: Callable[[Column], Column] = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "collapsed", longest.alias("best")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"),
        digest(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))

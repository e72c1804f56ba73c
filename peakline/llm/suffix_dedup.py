"""Removal of long byte strings that occur more than once in the corpus, exactly.

A byte goes when some string of `length` bytes covering it also starts anywhere else. Comparing all suffixes of a corpus in one place is
out of the question, so equal strings are first brought together by anchors: of all `gram`-byte windows inside a string of `length`
bytes the one with the smallest hash is its anchor, and equal strings have equal anchors at the same offset. Anchors are a small, evenly spaced part of all
positions. Anchors whose whole surroundings are equal settle by counting. Those that agree only in part are grouped by the half of the surroundings that a match
must also contain, and in every group the suffixes to the right of the anchor and the prefixes to its left are sorted by deep-shallow sorting; the common
prefixes of neighbours give the exact stretch of matching starts. Groups too large to gather are settled by counting hashes of every start.

Windows are compared by 64-bit hashes, surroundings by two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from peakline.llm.common import in_arrow, stored, whole_text
from peakline.llm.deep_shallow import common_prefix, deep_shallow
from peakline.llm.hashing import BYTE_VALUES, mixed, prefix_hashes, sorted_groups, window_hashes

#: Bytes of a string that must not occur twice, and of the windows among which its anchor is chosen.
LENGTH, GRAM = 400, 100
#: Largest group whose surroundings are sorted in one task; larger ones are settled by counting.
GROUP = 4000
#: Largest group in which the stretches of all pairs are laid over each other; in larger ones the members are classed start by start.
PAIRED = 64
#: Parts into which the rows of a large group are dealt where they meet their group's totals; at most 64, a bit each.
LANES = 64
_LOW = np.uint64((1 << 30) - 1)  # positions; texts are below 1 GB
_TOP = np.iinfo(np.uint64).max


def anchors_of(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost smallest value of every run of `width` values. Values are compared in their upper bits."""
    value = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    n = len(value)
    blocks = np.concatenate([value, np.full(-n % width, _TOP, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n - width + 1], ahead[width - 1:n])
    return np.unique(least & _LOW).astype(np.int64)


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, at, right, key, around, before, after) of every anchor: its text and position, the bytes from it that count, and hashes of its window, of its
    surroundings, and of the window with half of what a match needs besides, to the left or to the right."""
    reach = length - gram
    half = reach - reach // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "at", "right", "key", "around", "before", "after"]
        for batch in batches:
            held = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                n = len(raw)
                if n < length:
                    continue
                prefix = prefix_hashes(BYTE_VALUES[raw])
                grams = window_hashes(prefix, slice(0, n - gram + 1), slice(gram, n + 1))
                at = anchors_of(grams, reach + 1)
                start, end = np.maximum(at - reach, 0), np.minimum(at + length, n)
                shape = (at - start).astype(np.uint64) << np.uint64(32) | (end - at).astype(np.uint64)
                around = mixed(window_hashes(prefix, start, end) ^ mixed(shape))
                left_ok, right_ok = at >= half, at + gram + half <= n
                before = window_hashes(prefix, np.maximum(at - half, 0), at + gram)
                after = window_hashes(prefix, at, np.minimum(at + gram + half, n)) ^ np.uint64(1)
                held.append((np.full(len(at), row), at, end - at, grams[at], around, before, left_ok, after, right_ok))
            if held:
                row, at, right, key, around, before, left_ok, after, right_ok = map(np.concatenate, zip(*held, strict=True))
                signed = lambda x: pa.array(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(at, pa.int32()), pa.array(right.astype(np.int16)), signed(key), signed(around),
                                                  pa.array(before.view(np.int64), mask=~left_ok), pa.array(after.view(np.int64), mask=~right_ok)], names=names)

    return docs.transform(in_arrow, run, "row long, at int, right short, key long, around long, before long, after long")


def _between(order: list[int], lcp: np.ndarray) -> np.ndarray:
    """Common prefix of every two strings, from the neighbours' in sorted order; -1 with itself."""
    n = len(order)
    out = np.full((n, n), -1, np.int64)
    place = np.array(order)
    for i in range(n - 1):
        out[place[i], place[i + 1:]] = out[place[i + 1:], place[i]] = np.minimum.accumulate(lcp[i + 1:])
    return out


def matching_starts(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(member, low, high): the string of `length` bytes that begins k bytes left of the anchor, low <= k <= high, is also another member's.

    lefts are the bytes before the anchor in reverse. A start k matches when two members share length - k bytes to the right and k to the left.
    """
    n = len(rights)
    if n == 2:
        low, high = max(length - common_prefix(*rights), 0), common_prefix(*lefts)
        return [(m, low, high) for m in (0, 1)] if low <= high else []
    (order_r, lcp_r), (order_l, lcp_l) = deep_shallow(rights), deep_shallow(lefts)
    lcp_r, lcp_l = np.array(lcp_r), np.array(lcp_l)
    most = max(map(len, lefts))
    if n <= PAIRED:
        low, high = np.maximum(length - _between(order_r, lcp_r), 0), _between(order_l, lcp_l)
        one, other = np.nonzero(low <= high)
        turns = np.zeros((n, most + 2), np.int32)
        np.add.at(turns, (one, low[one, other]), 1)
        np.add.at(turns, (one, high[one, other] + 1), -1)
        hit = np.cumsum(turns, axis=1) > 0
    else:
        hit = np.zeros((n, most + 2), bool)
        right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
        for k in range(max(0, length - int(lcp_r.max())), min(most, int(lcp_l.max()), length) + 1):
            right_class[order_r] = np.cumsum(lcp_r < length - k)
            left_class[order_l] = np.cumsum(lcp_l < k)
            _, which, count = np.unique(right_class * (n + 1) + left_class, return_inverse=True, return_counts=True)
            hit[:, k] = count[which] > 1
    edges = np.diff(np.concatenate([np.zeros((n, 1), np.int8), hit.astype(np.int8)], axis=1), axis=1)
    return list(zip(*np.nonzero(edges == 1), np.nonzero(edges == -1)[1] - 1, strict=True))


def _resolved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for group in sorted_groups(batches, ["part"]):
        keys, around, left, context = (group.column(c).to_pylist() for c in ("key", "around", "left", "context"))
        names = list(dict.fromkeys(zip(keys, around, strict=True)))
        if len(names) < 2:
            continue
        first = {name: i for i, name in reversed(list(enumerate(zip(keys, around, strict=True))))}
        at = [first[name] for name in names]
        found = matching_starts([context[i][:left[i]][::-1] for i in at], [context[i][left[i]:] for i in at], length)
        if found:
            member, low, high = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([names[m][0] for m in member]), pa.array([names[m][1] for m in member]), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
                                             names=["key", "around", "low", "high"])


def _every_start(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(hash, key, around, start) of every string of `length` bytes in the surroundings."""
    for batch in batches:
        for key, around, left, context in zip(*(batch.column(c).to_pylist() for c in ("key", "around", "left", "context")), strict=True):
            prefix = prefix_hashes(BYTE_VALUES[np.frombuffer(context, np.uint8)])
            last = len(context) - length
            start = np.arange(max(last, -1) + 1)
            start = start[start <= left]
            n = len(start)
            hashes = window_hashes(prefix, start, start + length).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([key] * n, pa.int64()), pa.array([around] * n, pa.int64()), pa.array(left - start, pa.int32())],
                                             names=["hash", "key", "around", "start"])


def with_totals(rows: DataFrame, of: DataFrame, by: str, total: str) -> DataFrame:
    """`rows` with the number of rows of `of` that have their `by`, where it is more than one. Rows meet it in lanes by their `around`, and it is repeated for
    the lanes a group has, so that a large group is not one task."""
    lane = F.coalesce(F.pmod("around", F.lit(LANES)), F.lit(0)).cast("int")  # never null, so no filter of nulls on one side alone
    groups = of.select(by, lane.alias("lane")).groupBy(by).agg(F.count("*").alias(total), F.expr("bit_or(shiftleft(1L, lane))").alias("lanes")).filter(F.col(total) > 1)
    of_group = F.expr(f"explode(filter(sequence(0, {LANES - 1}), x -> (lanes & shiftleft(1L, x)) != 0))")
    return rows.withColumn("lane", lane).join(groups.select(by, total, of_group.alias("lane")), [by, "lane"]).drop("lane")


def repeated_stretches(docs: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """(row, cuts): stretches (first, end) of bytes that strings occurring more than once cover, one row per anchor, overlapping and in no order."""
    reach = length - gram
    found = stored(anchors(docs, length, gram))
    side = lambda c: F.first(c).alias(c)  # noqa: E731  equal for all anchors of a class
    classes = found.groupBy("key", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "right")).alias("one"), side("before"), side("after"))
    shared = stored(with_totals(classes, found, "key", "total"))
    # Classes that share their window with others, by what else a match must contain.
    sides = F.array(F.struct(F.col("before").alias("half"), F.lit(0).alias("side")), F.struct(F.col("after").alias("half"), F.lit(1).alias("side")))
    parts = (shared.filter("total > n").withColumn("s", F.explode(sides)).filter("s.half IS NOT NULL")
             .withColumn("part", F.xxhash64("key", "s.half", "s.side")).select("key", "around", "one", "part"))
    members = with_totals(parts, parts, "part", "members").select("one.row", F.struct(F.col("one.at").alias("at"), F.col("one.right").alias("right"), "key", "around", "part", (F.col("members") > group).alias("large")).alias("m"))
    asked = members.groupBy("row").agg(F.collect_list("m").alias("ms"))  # anchors of one text
    narrow = "part long, large boolean, key long, around long, left int, context binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, ms in zip(batch.column("text").to_pylist(), batch.column("ms").to_pylist(), strict=True):
                raw = text.encode()
                left = [min(m["at"], reach) for m in ms]
                values = [[m[c] for m in ms] for c in ("part", "large", "key", "around")]
                contexts = [raw[m["at"] - k:m["at"] + m["right"]] for m, k in zip(ms, left, strict=True)]
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([*values, left, contexts], types, strict=True)], names=["part", "large", "key", "around", "left", "context"])

    contexts = stored(docs.join(asked, "row").select("text", "ms").transform(in_arrow, cut, narrow))
    spread = contexts.filter("NOT large").select("part", "key", "around", "left", "context").repartition("part").sortWithinPartitions("part")
    resolved = spread.transform(in_arrow, lambda batches: _resolved(batches, length), "key long, around long, low int, high int")
    starts = contexts.filter("large").select("key", "around", "left", "context").transform(in_arrow, lambda batches: _every_start(batches, length), "hash long, key long, around long, start int").distinct()
    # Equal strings have their anchor at the same offset; the same string around two anchors of one text is no second one.
    # A member has a row for every start, so one string has few of the rows, however large its group.
    twice = starts.groupBy("hash", "key", "start").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    counted = starts.join(twice, ["hash", "key", "start"]).groupBy("key", "around").agg(F.sort_array(F.collect_set("start")).alias("s"))
    first = F.filter("s", lambda x, i: (i == 0) | (x - F.get("s", i - 1) > 1))
    last = F.filter("s", lambda x, i: F.coalesce(F.get("s", i + 1) - x > 1, F.lit(True)))
    counted = counted.select("key", "around", F.explode(F.arrays_zip(first.alias("low"), last.alias("high"))).alias("x")).select("key", "around", "x.low", "x.high")
    # Whole surroundings that occur twice need no more.
    whole = shared.filter("n > 1").select("key", "around", F.lit(-1).alias("low"), F.lit(-1).alias("high"))
    # One row per class: at most one stretch for every start in its surroundings.
    answers = stored(whole.unionByName(resolved).unionByName(counted).groupBy("key", "around").agg(F.collect_set(F.struct("low", "high")).alias("found")))
    left = F.least("at", F.lit(reach)).cast("int")

    def bytes_of(x):
        """The bytes that the strings from the highest to the lowest start cover."""
        high = F.when(x["high"] < 0, left).otherwise(x["high"])
        low = F.when(x["low"] < 0, F.greatest(F.lit(length) - F.col("right"), F.lit(0))).otherwise(x["low"])
        return F.struct((F.col("at") - high).cast("int").alias("first"), (F.col("at") - low + length).cast("int").alias("end"))

    return found.select("row", "at", "right", "key", "around").join(answers, ["key", "around"]).select("row", F.transform("found", bytes_of).alias("cuts"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "cuts")), strict=True):
            raw = text.encode()
            spans: list[list[int]] = []
            for cut in sorted((c["first"], c["end"]) for c in cuts or ()):
                if spans and cut[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], cut[1])
                else:
                    spans.append(list(cut))
            edges = [0, *(x for span in spans for x in span), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"first": a, "end": b} for a, b in spans]))
        if rows:
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every text without the bytes of strings that also start elsewhere, in the same text or another.

    Strings never cross texts, may overlap, and are judged on the input. Returns one row per row: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 (of the remaining bytes) and spans, the runs as (first, end) in bytes. A null text is empty; texts shorter than
    `length` stay whole; a repeated row repeats its whole text. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    # A row is known by its id and text: rows equal in both have the same result.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    cuts = repeated_stretches(rows.select("row", "text"), length, gram, group).groupBy("row").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    return rows.join(cuts, "row", "left").select("doc_id", "text", "cuts").transform(in_arrow, 
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:int,end:int>>")

"""Delimited text with quoted line breaks, read by many tasks.

Where a block of a file begins, nothing tells whether its first line begins a record or goes on inside a quoted field. So the file is
scanned first: a line maps the state at its start (outside or inside a quoted field) to the state at its end, and the maps of all lines of a block
compose to one. A prefix over the blocks of a file, one row each, gives the true state at the start of every block. The second scan cuts the blocks into records; only
pieces of records that cross the edge of a block are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakline.operators import limits
from peakline.operators.cut import measured
from peakline.operators.workers import shipped

_WHOLE, _HEAD, _TAIL = 0, 1, 2  # a record; the end of one that began before the block; the start of one that goes on behind it


def ends_inside(line: str, inside: bool, sep: str, quote: str) -> bool:
    """Whether a quoted field is open at the end of a line. A quote opens a field only where the field begins; a doubled quote stands for itself;
    what follows a closing quote up to the separator belongs to the field."""
    at = 0
    while True:
        if not inside:
            if not line.startswith(quote, at):
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
            at += 1
        close = line.find(quote, at)
        while close >= 0 and line.startswith(quote, close + 1):
            close = line.find(quote, close + 2)
        if close < 0:
            return True
        inside, at = False, line.find(sep, close + 1)
        if at < 0:
            return False
        at += len(sep)


def _maps(batches: Iterator[pa.RecordBatch], sep: str, quote: str) -> Iterator[pa.RecordBatch]:
    """(file, block, out, in): the state at the end of each stretch of lines of one block, by the state at its start."""
    place, state = None, [False, True]
    for batch in batches:
        done: list[tuple] = []
        for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("_file", "_block", "value")), strict=True):
            if (file, block) != place:
                if place:
                    done.append((*place, *state))
                place, state = (file, block), [False, True]
            state = [ends_inside(line, s, sep, quote) for s in state]
        if done:
            yield _batch(done, [("_file", pa.string()), ("_block", pa.int64()), ("_from_out", pa.bool_()), ("_from_in", pa.bool_())])
    if place:
        yield _batch([(*place, *state)], [("_file", pa.string()), ("_block", pa.int64()), ("_from_out", pa.bool_()), ("_from_in", pa.bool_())])


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)], names=[n for n, _ in columns])


def _cut(batches: Iterator[pa.RecordBatch], sep: str, quote: str) -> Iterator[pa.RecordBatch]:
    """(file, block, pos, kind, record) of the records and pieces of records of each block. Lines arrive in order."""
    columns = [("_file", pa.string()), ("_block", pa.int64()), ("_pos", pa.int64()), ("_kind", pa.int32()), ("record", pa.string())]
    place, line_no, inside = None, 0, False
    start, kind, parts = 0, _WHOLE, []
    for batch in batches:
        out: list[tuple] = []
        for file, block, begins_inside, line in zip(*(batch.column(c).to_pylist() for c in ("_file", "_block", "_inside", "value")), strict=True):
            if (file, block) != place:
                if parts:
                    out.append((*place, start, _TAIL if kind == _WHOLE else _HEAD, "\n".join(parts)))
                if begins_inside is None:
                    raise ValueError(f"the blocks of {file} changed between two scans")
                place, line_no, inside, parts = (file, block), 0, begins_inside, []
                kind = _HEAD if inside else _WHOLE
            if not parts:
                start = block + line_no  # every line has a byte at least, so positions grow over the blocks of a file
            parts.append(line.removesuffix("\r"))
            line_no += 1
            if quote in line:
                inside = ends_inside(line, inside, sep, quote)
            if not inside:
                out.append((*place, start, kind, parts[0] if len(parts) == 1 else "\n".join(parts)))
                kind, parts = _WHOLE, []
        if out:
            yield _batch(out, columns)
    if parts:
        yield _batch([(*place, start, _TAIL if kind == _WHOLE else _HEAD, "\n".join(parts))], columns)


def quoted_records(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> DataFrame:
    """(file, pos, record) of the records of delimited text files, line breaks in quoted fields included.

    `pos` grows with the order of the records in their file and is 0 for the first one. Line breaks are those of a line feed, with or without a
    carriage return before it. A field that is still open where its file ends closes there.
    """
    shipped(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value", F.monotonically_increasing_id().alias("_line"))
    quoted = lines.select("_file", "_block", "value").filter(F.contains("value", F.lit(quote)))
    maps = quoted.mapInArrow(lambda batches: _maps(batches, sep, quote), "_file string, _block long, _from_out boolean, _from_in boolean")
    # A block without quotes leaves the state as it is. Every block is there once: one scan task reads all of it.
    blocks = lines.select("_file", "_block").distinct().join(maps, ["_file", "_block"], "left")
    turns = F.when(F.col("_from_out") & ~F.col("_from_in"), 1).otherwise(0)
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumn("_turns", F.sum(turns).over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # The last block that ends in one state whatever it began in, and the turns since then.
    fixed = F.when(F.col("_from_out") == F.col("_from_in"), F.struct(F.col("_from_out").cast("int").alias("state"), "_turns"))
    last, turned = F.last(fixed, ignorenulls=True).over(before), F.coalesce(F.lag("_turns").over(Window.partitionBy("_file").orderBy("_block")), F.lit(0))
    state = (F.coalesce(last["state"] - last["_turns"], F.lit(0)) + turned) % 2 != 0
    states, seen = measured(summed.select("_file", "_block", state.alias("_inside")), n=F.count(F.lit(1)))
    if seen["n"] <= limits.FEW_SERIES:
        placed = lines.join(F.broadcast(states), ["_file", "_block"], "left")
    else:  # more blocks than may be broadcast: lines go to their block's state, in order
        placed = lines.join(states.hint("merge"), ["_file", "_block"], "left").sortWithinPartitions("_file", "_block", "_line")
    cut_ = placed.select("_file", "_block", "_inside", "value").mapInArrow(lambda batches: _cut(batches, sep, quote), "_file string, _block long, _pos long, _kind int, record string")
    pieces, found = measured(cut_, split=F.count_if(F.col("_kind") != _WHOLE))
    whole = pieces.filter(F.col("_kind") == _WHOLE).select(F.col("_file").alias("file"), F.col("_pos").alias("pos"), "record")
    if not found["split"]:
        return whole
    # Two pieces per block at most: a record's first piece opens a group, the pieces up to the next one belong to it.
    split = pieces.filter(F.col("_kind") != _WHOLE)
    opened = F.max(F.when(F.col("_kind") == _TAIL, F.col("_pos"))).over(Window.partitionBy("_file").orderBy("_block", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = (split.withColumn("pos", opened).groupBy(F.col("_file").alias("file"), "pos")
              .agg(F.array_sort(F.collect_list(F.struct("_block", "_kind", "record"))).alias("_p")).select("file", "pos", F.array_join("_p.record", "\n").alias("record")))
    return whole.unionByName(joined)


def fields(records: DataFrame, count: int, sep: str = ",", quote: str = '"', names: Sequence[str] | None = None) -> DataFrame:
    """`records` with the fields of each as an array of `count` texts; a field that is missing or empty without quotes is null. Given `names`, the first
    record of every file must hold them, and is left out."""
    schema = ", ".join(f"c{k} string" for k in range(count))
    parsed = F.from_csv("record", schema, {"sep": sep, "quote": quote, "escape": quote})
    table = records.withColumn("_row", parsed).withColumn("fields", F.array(*[F.col(f"_row.c{k}") for k in range(count)])).drop("_row", "record")
    if names is None:
        return table
    header = F.transform("fields", lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit("﻿ \t\r")))
    same = F.assert_true(header == F.array(*[F.lit(n) for n in names]), F.concat(F.lit("another header in "), "file"))
    return table.filter(F.when(F.col("pos") == 0, same.isNotNull()).otherwise(F.lit(True)))

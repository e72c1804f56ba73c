"""Local maxima, thresholds and minimum spacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakline.operators.chunks import (
    CHUNK, DEFAULT_CHUNK, HOME, SERIES, bucket_prefix, chunk_window, dealt, floor_div, with_halo)
from peakline.operators.cut import measured
from peakline.operators.kernels import DROPPED, KEPT, WAITING, group_numbers, resolve, whole_groups
from peakline.operators.workers import shipped


# Marks on `top`: not a maximum, a maximum, and the end of a flat top that began in an earlier chunk.
_NO_TOP, _TOP, _OPEN_TOP = 0, 1, 2


def mark_tops(spread: DataFrame, col: str) -> DataFrame:
    """Add `rise`, `left` and `top` to chunked rows that see one row beyond each chunk edge.

    A flat top is recognised at its last sample: the next value is lower and the run rose at its
    start. `rise` tells whether the value went up or down here (null where it stayed), `left` is
    where the current run began.
    """
    rows = chunk_window()
    before, after = F.lag(col).over(rows), F.lead(col).over(rows)
    rise = F.when(before != F.col(col), F.col(col) > before).when(before.isNull() & (F.col("idx") == 0), F.lit(False))
    marked = spread.withColumn("rise", rise).withColumn("_falls", after < F.col(col))
    turn = F.when(F.col("rise").isNotNull(), F.struct("idx", "rise"))
    marked = marked.withColumn("_run", F.last(turn, ignorenulls=True).over(
        rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    top = (F.when(F.col("_falls") & F.col("_run").isNull(), F.lit(_OPEN_TOP))
           .when(F.col("_falls") & F.col("_run.rise"), F.lit(_TOP)).otherwise(F.lit(_NO_TOP)))
    return marked.withColumn("top", top).withColumn("left", F.col("_run.idx")).drop("_run", "_falls")


def open_tops() -> Column:
    """How many tops wait for their start; a total for `measured`."""
    return F.count_if(F.col("top") == _OPEN_TOP)


def tops_of(marked: DataFrame, waiting_tops: int, col: str, carry: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """(keys, _chunk, idx, left, right, value) of the local maxima in marked rows.

    Tops that began in an earlier chunk, one per chunk at most, look their start up in a summary of
    the last change of each chunk. `waiting_tops` tells whether there are any, `chunks` is the number of chunks of the longest series, if known.
    """
    def table(rows: DataFrame, left) -> DataFrame:
        return rows.select(*SERIES, CHUNK, floor_div(left + F.col("idx"), 2).alias("idx"), left.alias("left"),
                           F.col("idx").alias("right"), F.col(col).alias("value"), *carry)

    done = table(marked.filter(F.col("top") == _TOP), F.col("left"))
    if not waiting_tops:
        return done
    waiting = marked.filter(F.col("top") == _OPEN_TOP)
    # Plain columns, which are counted by hash; the largest of structs would sort all samples.
    changed = F.col("rise").isNotNull()
    last = F.max(F.when(changed, F.col("idx")))
    turns = (marked.filter(changed | (F.col("top") == _OPEN_TOP)).groupBy(*SERIES, CHUNK)
             .agg(F.when(last.isNotNull(), F.struct(last.alias("idx"), F.max_by("rise", F.when(changed, F.col("idx"))).alias("rise"))).alias("_turn")))
    runs = bucket_prefix(turns, SERIES, CHUNK, "_turn", "last", "_run", buckets=chunks).drop("_turn")
    resumed = waiting.join(runs, [*SERIES, CHUNK]).filter(F.col("_run.rise"))
    return done.unionByName(table(resumed, F.col("_run.idx")))


def local_maxima(df: DataFrame, col: str = "smooth", carry: Sequence[str] = (), chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """(keys, idx, left, right, value) of every strict local maximum of a series.

    A flat top counts once, at (left + right) div 2; the two ends of a series never count. `carry`
    columns are those of the last sample of the top.
    """
    spread = with_halo(df.select(*SERIES, "idx", col, *[c for c in carry if c != col]), chunk, before=1, after=1)
    marked = mark_tops(spread, col).filter(F.col(HOME) & (F.col("rise").isNotNull() | (F.col("top") > 0)))
    marked, seen = measured(marked, open_tops=open_tops())
    return tops_of(marked, seen["open_tops"], col, carry).drop(CHUNK)


def peaks_above(df: DataFrame, height, col: str = "value") -> DataFrame:
    """Keep rows at or above a height, a column name or a number."""
    level = F.col(height) if isinstance(height, str) else F.lit(height)
    return df.filter(F.col(col) >= level)


# Greedy suppression ------------------------------------------------------------------------------

def _suppression_pass(candidates: DataFrame, keys: Sequence[str], pos: str, group: str | None,
                      best_first: Sequence[tuple[str, bool]], distance: float, span: float,
                      halo: float) -> DataFrame:
    """One round over spans of the position axis: updates `_state` (kept or waiting; dropped rows go)."""
    def span_of(at):
        return F.floor(at / F.lit(span)).cast("long")

    rows = (candidates.withColumn(CHUNK, F.explode(F.sequence(span_of(F.col(pos) - F.lit(halo)), span_of(F.col(pos) + F.lit(halo)))))
            .withColumn(HOME, F.col(CHUNK) == span_of(F.col(pos))))
    names = list(candidates.columns)
    parts = [*keys, CHUNK]
    runs = parts if group is None else [*parts, group]

    def solve(batches):
        import numpy as np

        for pdf in whole_groups(batches, parts):
            known = pdf["_state"].to_numpy() == KEPT
            ranks = [-pdf[c].to_numpy() if down else pdf[c].to_numpy() for c, down in reversed(list(best_first))]
            first = pdf[CHUNK].to_numpy() * span
            pdf["_state"] = resolve(pdf[pos].to_numpy(), group_numbers(pdf, runs), np.lexsort([*ranks, ~known]), distance,
                                    first - halo, first + span + halo, known)
            yield pdf.loc[pdf[HOME] & (pdf["_state"] != DROPPED), names]

    shipped(rows.sparkSession)
    return dealt(rows, *parts).sortWithinPartitions(*runs, pos).mapInPandas(solve, schema=candidates.schema)


def suppress(candidates: DataFrame, keys: Sequence[str], pos: str, best_first: Sequence[tuple[str, bool]],
             distance: float, group: str | None = None, reach: int = 32, span: int = 1024,
             widest: int = 65_536) -> DataFrame:
    """Keep candidates greedily, best first, none closer than `distance` to one already kept.

    `best_first` lists (column, descending); `span` and `reach` count distances. Whether a candidate
    stays depends only on better ones nearby, so it is decided inside a span of the axis plus a
    margin. Candidates at the end of a chain of ever better rivals that leaves the margin are left
    waiting for the next round, which sees only them and the kept ones and, up to `widest`, larger
    spans. Each round decides at least the best of what waits, so the rounds end with the exact
    result, and no task ever holds more than one stretch of the axis.
    """
    rows = candidates.withColumn("_state", F.lit(WAITING).cast("byte"))
    while True:
        rows, seen = measured(_suppression_pass(rows, keys, pos, group, best_first, distance, float(span) * distance, float(reach) * distance),
                              waiting=F.count_if(F.col("_state") == WAITING))
        if not seen["waiting"]:
            return rows.drop("_state")
        if span * 16 <= widest:
            span, reach = span * 16, reach * 16


def suppress_by_distance(peaks: DataFrame, distance: int, keys: Sequence[str] = SERIES, group: str | None = None, **how) -> DataFrame:
    """Minimum index distance between peaks: higher first, the later of two equal ones first."""
    if distance <= 1:
        return peaks
    return suppress(peaks, keys, "idx", [("value", True), ("idx", True)], distance, group, **how)

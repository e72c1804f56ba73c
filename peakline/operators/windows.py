"""Time windows around peaks: building, merging, clean-up, capping and cooldown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakline.config import DetectConfig
from peakline.functions.color import color_class, color_rank
from peakline.operators import limits
from peakline.operators.chunks import SERIES, bucket_prefix, largest_group, number_rows
from peakline.operators.cut import cut, measured
from peakline.operators.peaks import suppress, suppress_by_distance

BUCKET_S = 3600.0


def windows_around(peaks: DataFrame, cfg: DetectConfig) -> DataFrame:
    """One window per peak, pre_s before to post_s after."""
    t = F.col("idx") / F.lit(cfg.fps)
    return peaks.select(*SERIES, "idx", t.alias("peak_s"), F.col("value").alias("peak_val"),
                        (t - F.lit(cfg.pre_s)).alias("start_s"), (t + F.lit(cfg.post_s)).alias("end_s"))


def spaced_peak_windows(candidates: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Minimum spacing, then one window per peak that is left."""
    return windows_around(suppress_by_distance(candidates, cfg.peak_distance), cfg)


def union_cameras(*peaks: DataFrame) -> DataFrame:
    """Candidates of all cameras of a game in one table."""
    out = peaks[0]
    for more in peaks[1:]:
        out = out.unionByName(more)
    return out


def _islands(rows: DataFrame, keys: list[str], gap_s: float) -> DataFrame:
    """Merging with one window per key, for keys known to be small."""
    by_start = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    before = F.max("end_s").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start_s") > before + F.lit(gap_s)), F.col("start_s"))
    island = F.max("_opens").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn("_opens", opens).withColumn("_island", island)
            .groupBy(*keys, F.col("_island").alias("start_s")).agg(F.max("end_s").alias("end_s")))


def _islands_by_hour(rows: DataFrame, keys: list[str], gap_s: float) -> DataFrame:
    """Merging in steps: "everything before" is folded per hour of start time, then across hours,
    so neither a long game nor one endless island is gathered in a task."""
    rows = rows.withColumn("_hour", _hour_of("start_s"))
    first, last = rows.agg(F.min("_hour"), F.max("_hour")).first()
    hours = 0 if first is None else last - first + 1
    in_hour = Window.partitionBy(*keys, "_hour").orderBy("start_s", "end_s").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_hour").agg(F.max("end_s").alias("_end"))
    ended = bucket_prefix(ends, keys, "_hour", "_end", "max", "_ended", buckets=hours).drop("_end")
    rows = rows.join(ended, [*keys, "_hour"], "left")
    before = F.greatest(F.max("end_s").over(in_hour), F.col("_ended"))
    rows = cut(rows.withColumn("_before", before).withColumn(
        "_opens", F.when(F.col("_before").isNull() | (F.col("start_s") > F.col("_before") + F.lit(gap_s)), F.col("start_s"))))
    opened = rows.groupBy(*keys, "_hour").agg(F.max("_opens").alias("_last"))
    opened = bucket_prefix(opened, keys, "_hour", "_last", "last", "_open", buckets=hours).drop("_last")
    so_far = Window.partitionBy(*keys, "_hour").orderBy("start_s", "end_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.join(opened, [*keys, "_hour"], "left")
            .withColumn("_island", F.coalesce(F.max("_opens").over(so_far), F.col("_open")))
            .groupBy(*keys, F.col("_island").alias("start_s")).agg(F.max("end_s").alias("end_s")))


def _hour_of(second: str):
    return F.floor(F.col(second) / F.lit(BUCKET_S)).cast("long")


def merge_intervals(intervals: DataFrame, gap_s: float, keys: tuple[str, ...] = ("game_id",)) -> DataFrame:
    """Union of intervals that overlap or lie at most gap_s apart, numbered by start within a game.

    An interval opens a new island when it starts after everything before it has ended; an island
    ends where its last interval does. Which way the islands are found depends on the counted size
    of the largest game.
    """
    keys = list(keys)
    rows, seen = measured(intervals.select(*keys, "start_s", "end_s"), n=F.count(F.lit(1)))
    one_window = seen["n"] <= limits.SMALL_GROUP or largest_group(rows, keys) <= limits.SMALL_GROUP
    merged = _islands(rows, keys, gap_s) if one_window else cut(_islands_by_hour(rows, keys, gap_s))
    if one_window:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("start_s")).cast("long")
        numbered = merged.withColumn("window_id", number)
    else:
        numbered = number_rows(merged, keys, [("_hour", _hour_of("start_s"))], ["start_s"], "window_id")
    return numbered.select(*keys, "window_id", "start_s", "end_s")


def sanitize_windows(windows: DataFrame, min_s: float = 0.5) -> DataFrame:
    """No negative start; at least min_s long."""
    start = F.greatest(F.lit(0.0), F.col("start_s"))
    return windows.withColumn("start_s", start).withColumn("end_s", F.greatest(F.col("start_s") + F.lit(min_s), F.col("end_s")))


def cap_duration(scored: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Cut the end of long windows, later for big plays. The score is not touched."""
    big = color_rank(F.col("color")) >= F.lit(cfg.big_rank)
    limit = F.when(big, F.lit(float(cfg.max_big_win_s))).otherwise(F.lit(float(cfg.max_win_s)))
    too_long = F.col("end_s") - F.col("start_s") > limit
    return scored.withColumn("end_s", F.when(too_long, F.col("start_s") + limit).otherwise(F.col("end_s")))


def cooldown(scored: DataFrame, seconds: float, **how) -> DataFrame:
    """Of windows that start less than `seconds` apart keep the higher score, the earlier on a tie."""
    if seconds <= 0:
        return scored
    return suppress(scored, ["game_id"], "start_s", [("score", True), ("start_s", False)], seconds, **how)


def with_color(scored: DataFrame) -> DataFrame:
    return scored.withColumn("color", color_class(F.col("score")))

"""Edits on a timeline in table form: range expansion, cuts, angles, marker merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakline.functions.text import parse_cam_angle, parse_color, parse_win_seconds, seconds_to_frames, strip
from peakline.operators.chunks import bucket_prefix, explode_range, floor_div
from peakline.operators.cut import cut, measured

FRAMES_PER_BIN = 4096
#: What stands at a frame, in the order in which it counts.
CLIP_END, CUT, CLIP_START = 0, 1, 2
RANGE_END, MIDDLE = 0, 1

MARKER_SIGNATURE = ["game_id", "frame", "color", "name", "note", "duration"]


def _expandable(fps: float) -> Column:
    """Needs `_win`, the seconds of the note. A length that is no number of frames (see `win_frames`) is no length."""
    return F.coalesce((F.upper(strip(F.coalesce("name", F.lit("")))) != "REPLAY") & (F.col("_win") > 0) & seconds_to_frames(F.col("_win"), fps).isNotNull(), F.lit(False))


def expand_markers(markers: DataFrame, fps: float, start_frame: int = 0) -> DataFrame:
    """Point markers to ranges on the absolute frame axis, with colour and 0-based angle."""
    name, note = strip(F.coalesce("name", F.lit(""))), F.coalesce("note", F.lit(""))
    length = F.greatest(F.lit(1).cast("long"), seconds_to_frames(F.col("_win"), fps))
    offset = F.lit(start_frame).cast("long")
    parsed = markers.select("game_id", "seq", "frame", "name", "note", parse_win_seconds(F.col("note")).alias("_win"))
    return (parsed.filter(_expandable(fps))
            .select("game_id", "seq", "frame", parse_color(name, note).alias("color"), name.alias("name"), note.alias("note"),
                    length.alias("duration"), (F.col("frame") + offset).alias("start_frame"),
                    (F.col("frame") + length + offset).alias("end_frame"), parse_cam_angle(name, note).alias("angle")))


def expansion_counts(markers: DataFrame, fps: float = 60) -> DataFrame:
    """Markers expanded and skipped per game."""
    known = markers.select("game_id", "name", parse_win_seconds(F.col("note")).alias("_win")).select("game_id", _expandable(fps).cast("long").alias("_yes"))
    return known.groupBy("game_id").agg(F.sum("_yes").alias("expanded"), F.sum(1 - F.col("_yes")).alias("skipped"))


def split_points(ranges: DataFrame) -> DataFrame:
    """Distinct range boundaries of a game."""
    return (ranges.select("game_id", F.explode(F.array("start_frame", "end_frame")).alias("frame")).distinct())


def _in_bin(backwards: bool = False):
    """The rows of a bin before the current one, or behind it, in the order of frames and kinds."""
    frame, kind = (F.desc("frame"), F.desc("_kind")) if backwards else (F.asc("frame"), F.asc("_kind"))
    return Window.partitionBy("game_id", "_bin").orderBy(frame, kind).rowsBetween(Window.unboundedPreceding, -1)


def _over_bins(bins: DataFrame, value: str, how: str, out: str, backwards: bool, most: int) -> DataFrame:
    """Folds over the bins that have rows. An axis of 2^52 frames has 2^40 bins: three levels of FAN_OUT leave sixteen blocks."""
    return bucket_prefix(bins, ["game_id"], "_bin", value, how, out, backwards=backwards, buckets=most, depth=3)


def _ranked(clips: DataFrame, points: DataFrame) -> DataFrame:
    """(game_id, frame, _kind, _rank, _next) for every distinct cut and end of a clip.

    `_rank` counts the cuts before the row, `_next` is the first cut behind it. At one frame the end of a clip comes before a cut
    and a start behind it, so a cut at an edge of a clip is not inside. Rows are folded inside bins, then over
    the bins that have rows; a bin holds each frame three times at most, however many clips begin there.
    """
    def of(df: DataFrame, frame: str, kind: int) -> DataFrame:
        return df.select("game_id", F.col(frame).alias("frame"), F.lit(kind).alias("_kind"))

    rows = of(clips, "end_frame", CLIP_END).unionByName(of(points, "frame", CUT)).unionByName(of(clips, "start_frame", CLIP_START)).distinct()
    rows = rows.withColumn("_bin", floor_div(F.col("frame"), FRAMES_PER_BIN)).withColumn("_cut", F.when(F.col("_kind") == CUT, F.col("frame")))
    bins, seen = measured(rows.groupBy("game_id", "_bin").agg(F.count("_cut").alias("_cuts"), F.min("_cut").alias("_first")), n=F.count(F.lit(1)))
    most = seen["n"]
    folded = _over_bins(_over_bins(bins, "_cuts", "sum", "_before", False, most), "_first", "last", "_behind", True, most)
    rank = F.col("_before") + F.count("_cut").over(_in_bin())
    ahead = F.last("_cut", ignorenulls=True).over(_in_bin(backwards=True))
    return (rows.join(folded.drop("_cuts", "_first"), ["game_id", "_bin"])
            .select("game_id", "frame", "_kind", rank.alias("_rank"), F.coalesce(ahead, F.col("_behind")).alias("_next")))


def split_clips(clips: DataFrame, points: DataFrame) -> DataFrame:
    """Cut each clip at every point strictly inside it; the pieces keep the clip's other columns.

    Cuts are numbered in their game, and a clip looks up how many lie before its start and before its end. The
    numbers between are its cuts: one row each, joined by number, so the rows made are the pieces returned, whether a clip is one frame or
    2^50 long. The next cut is a property of the cut; a clip with many of them is never gathered. Clips that are empty or lack an edge stay.
    """
    ranked = cut(_ranked(clips, points))
    of = lambda kind, *columns: ranked.filter(F.col("_kind") == kind).select("game_id", *columns)
    rest = [c for c in clips.columns if c not in ("game_id", "clip_id", "start_frame", "end_frame")]
    known = clips.join(of(CLIP_START, F.col("frame").alias("start_frame"), F.col("_rank").alias("_low"), "_next"), ["game_id", "start_frame"], "left")
    heads = known.select("game_id", "clip_id", "start_frame", F.when(F.col("_next") < F.col("end_frame"), F.col("_next")).otherwise(F.col("end_frame")).alias("end_frame"), *rest)
    inside = known.filter(F.col("_next") < F.col("end_frame")).drop("_next").join(of(CLIP_END, F.col("frame").alias("end_frame"), F.col("_rank").alias("_high")), ["game_id", "end_frame"])
    numbered = explode_range(inside, F.col("_low"), F.col("_high") - 1, "_rank")
    tails = (numbered.join(of(CUT, "frame", "_rank", "_next"), ["game_id", "_rank"])
             .select("game_id", "clip_id", F.col("frame").alias("start_frame"), F.least("_next", "end_frame").alias("end_frame"), *rest))
    return heads.unionByName(tails)


def assign_angles(clips: DataFrame, ranges: DataFrame) -> DataFrame:
    """Give each clip the angle of the first range, in frame order, that holds its midpoint.

    Of the ranges that end behind a midpoint the one that begins first either holds it or begins behind it, as all others then do. So each
    midpoint needs the least start among the range ends behind it: one fold over the frames, one row per distinct end and
    midpoint, however long the ranges are and however many overlap. Clips without a match keep the angle they have (null without an `angle`
    column); repeated clips stay. Of ranges that begin together the first by `seq`, then angle, counts.
    """
    if "angle" not in clips.columns:
        clips = clips.withColumn("angle", F.lit(None).cast("int"))
    clips = cut(clips.withColumn("_middle", F.floor((F.col("start_frame") + F.col("end_frame")) / F.lit(2)).cast("long")))
    least = F.min(F.struct("start_frame", "seq", "angle"))
    ends = ranges.groupBy("game_id", F.col("end_frame").alias("frame")).agg(least.alias("_range")).withColumn("_kind", F.lit(RANGE_END))
    middles = clips.select("game_id", F.col("_middle").alias("frame")).distinct().withColumn("_kind", F.lit(MIDDLE))
    rows = ends.unionByName(middles, allowMissingColumns=True).withColumn("_bin", floor_div(F.col("frame"), FRAMES_PER_BIN))
    bins, seen = measured(rows.groupBy("game_id", "_bin").agg(F.min("_range").alias("_least")), n=F.count(F.lit(1)))
    behind = _over_bins(bins, "_least", "min", "_behind", True, seen["n"]).drop("_least")
    first = F.least(F.min("_range").over(_in_bin(backwards=True)), F.col("_behind"))
    found = (rows.join(behind, ["game_id", "_bin"]).select("game_id", "frame", "_kind", first.alias("_range"))
             .filter((F.col("_kind") == MIDDLE) & (F.col("_range.start_frame") <= F.col("frame"))).select("game_id", F.col("frame").alias("_middle"), "_range"))
    return (clips.join(found, ["game_id", "_middle"], "left")
            .withColumn("angle", F.coalesce(F.col("_range.angle"), F.col("angle"))).drop("_range", "_middle"))


def marker_signature(markers: DataFrame) -> DataFrame:
    """Signature columns with their defaults."""
    return markers.select(
        "game_id", "frame", F.coalesce("color", F.lit("Blue")).alias("color"), F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("note", F.lit("")).alias("note"),
        F.coalesce(F.nullif(F.col("duration"), F.lit(0)), F.lit(1)).cast("long").alias("duration"))


def new_markers(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Source markers the destination does not have, each once.

    Both sides are reduced to distinct signatures first, combined on the map side, so a marker
    repeated in a third of all rows reaches the join as one row.
    """
    have = marker_signature(dst).distinct()
    return marker_signature(src).distinct().join(have, MARKER_SIGNATURE, "left_anti")


def merge_markers(src: DataFrame, dst: DataFrame, dedupe: bool = True) -> DataFrame:
    added = new_markers(src, dst) if dedupe else marker_signature(src)
    return marker_signature(dst).unionByName(added)


def merge_counts(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Markers copied and skipped per game by a de-duplicating merge."""
    copied = new_markers(src, dst).groupBy("game_id").agg(F.count(F.lit(1)).alias("copied"))
    total = src.groupBy("game_id").agg(F.count(F.lit(1)).alias("_all"))
    zero = F.lit(0).cast("long")
    return (total.join(copied, "game_id", "left").withColumn("copied", F.coalesce("copied", zero))
            .select("game_id", "copied", (F.col("_all") - F.col("copied")).alias("skipped")))


def replace_markers(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Clear the destination of every game the source has, then copy the source."""
    untouched = dst.join(src.select("game_id").distinct(), "game_id", "left_anti")
    return marker_signature(untouched).unionByName(marker_signature(src).distinct())

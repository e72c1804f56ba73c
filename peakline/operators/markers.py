"""Marker tables: from scored windows, from raw text rows, and as interchange lines.

A marker table is (game_id, seq, frame, name, note, color, duration). `seq` is the order of
emission; readers order by (frame, seq), which keeps a stable sort reproducible on a cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakline.config import DetectConfig
from peakline.functions.color import color_class, color_rank
from peakline.functions.text import MOST_FRAMES, fixed, marker_label, parse_win_seconds, seconds_to_frames, strip, tag_note, xml_escape
from peakline.functions.timecode import frames_to_tc, rational_time, sec_to_frame, tc_to_frames
from peakline.operators.chunks import floor_div, number_rows
from peakline.operators.cut import cut

MARKER_COLUMNS = ["game_id", "seq", "frame", "name", "note", "color", "duration"]

# Titles and texts of the interchange formats.
EDL_TITLE = "TITLE: HOCKEY_WINDOWS"
EDL_FRAME_MODE = "FCM: NON-DROP FRAME"
EDL_START = "01:00:00:00"
EDL_CUT = "%s  AX       V     C        %s %s %s %s"
XML_PROJECT = "AI Markers"
XML_TAIL_S = 5


def _marker_parts(scored: DataFrame, timeline_fps: int) -> DataFrame:
    win_s = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    note = F.concat(F.lit("score="), fixed(F.col("score"), 2), F.lit(" conf="), fixed(F.col("conf"), 2),
                    F.lit(" win="), fixed(win_s, 1), F.lit("s"))
    return (scored.withColumn("color", color_class(F.col("score")))
            .withColumn("_frame", sec_to_frame(F.col("start_s"), timeline_fps))
            .withColumn("_duration", F.greatest(F.lit(1).cast("long"), sec_to_frame(win_s, timeline_fps)))
            .withColumn("_name", F.concat(F.lit("PLAY cam"), F.col("primary_cam").cast("string")))
            .withColumn("_note", note))


def _play() -> Column:
    return F.struct((F.col("window_id") * 2).cast("long").alias("seq"), F.col("_frame").alias("frame"), F.col("_name").alias("name"),
                    F.col("_note").alias("note"), F.col("color").alias("color"), F.col("_duration").alias("duration"))


def to_markers(scored: DataFrame, timeline_fps: int) -> DataFrame:
    """One PLAY marker per scored window."""
    return _marker_parts(scored, timeline_fps).select("game_id", _play().alias("_m")).select("game_id", "_m.*")


def replay_markers(scored: DataFrame, cfg: DetectConfig) -> DataFrame:
    """PLAY markers, each big play followed by a one-frame REPLAY marker after its end."""
    after = F.concat(F.lit(f"after={cfg.replay_offset_s:.1f}s from end | "), F.col("_name"), F.lit(" | "), F.col("_note"))
    replay = F.struct(
        (F.col("window_id") * 2 + 1).cast("long").alias("seq"),
        sec_to_frame(F.col("end_s") + F.lit(float(cfg.replay_offset_s)), cfg.timeline_fps).alias("frame"),
        F.lit("REPLAY").alias("name"), after.alias("note"), F.col("color").alias("color"),
        F.lit(1).cast("long").alias("duration"))
    big = color_rank(F.col("color")) >= F.lit(cfg.big_rank)
    both = F.when(big, F.array(_play(), replay)).otherwise(F.array(_play()))
    return (_marker_parts(scored, cfg.timeline_fps).select("game_id", F.explode(both).alias("_m")).select("game_id", "_m.*"))


# Raw marker rows ---------------------------------------------------------------------------------

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def numeric(col: Column) -> Column:
    """The value of a numeric text, else null (also for inf and nan)."""
    return F.regexp_extract(strip(col), _NUMBER, 0).try_cast("double")


def whole(number: Column) -> Column:
    """The integer part; null beyond MOST_FRAMES."""
    return F.when(F.abs(number) <= MOST_FRAMES, number).try_cast("long")


def whole_number(col: Column) -> Column:
    """The integer part of a numeric text, else null (also for inf, nan and beyond MOST_FRAMES)."""
    return whole(numeric(col))


def _clean(raw: DataFrame, *more: Column) -> DataFrame:
    """Rows with a frame number. Texts are parsed in a projection of their own: what is made of them names them several times, and
    each name would parse them anew."""
    def text(name: str) -> Column:
        return strip(F.coalesce(F.col(name), F.lit("")))

    parsed = raw.select("game_id", "seq", numeric(F.col("Frame")).alias("_frame"), text("Name").alias("_name"), text("Note").alias("_note"), text("Color").alias("_color"),
                        parse_win_seconds(strip(F.coalesce(F.col("Note"), F.lit("")))).alias("_win"), *more)
    return parsed.withColumn("_frame", whole(F.col("_frame"))).filter(F.col("_frame").isNotNull())


def normalize_markers(raw: DataFrame, fps: int) -> DataFrame:
    """Typed markers: the Duration column counts, the note's `win=` only where it is not a number."""
    return _typed(_clean(raw, _duration()), fps)


def _duration() -> Column:
    return numeric(F.col("Duration")).alias("_duration")


def _typed(clean: DataFrame, fps: int, *more: Column) -> DataFrame:
    one = F.lit(1).cast("long")
    length = F.coalesce(whole(F.col("_duration")), seconds_to_frames(F.col("_win"), fps), one)
    return clean.select(
        "game_id", "seq", F.col("_frame").alias("frame"), F.col("_name").alias("name"), F.col("_note").alias("note"),
        F.when(F.col("_color") == "", F.lit("Blue")).otherwise(F.col("_color")).alias("color"),
        F.greatest(one, length).alias("duration"), *more)


def number_by_frame(df: DataFrame, frame: str, name: str) -> DataFrame:
    """Position within a game by (frame, seq)."""
    # Frames are below 2^52: every level has at most 4,096 buckets inside one of the level above.
    levels = [(f"_f{bits}", floor_div(F.col(frame), 1 << bits)) for bits in (44, 32, 20, 8)] + [("_f", F.col(frame))]
    levels += [(f"_s{bits}", floor_div(F.col("seq"), 1 << bits)) for bits in (40, 28, 16)]
    return number_rows(df, ["game_id"], levels, [frame, "seq"], name)


def to_edl_events(raw: DataFrame, fps: int) -> DataFrame:
    """Cut-list events: length from the note's `win=` alone, one frame for replays and rows without it."""
    return (number_by_frame(_events(_clean(raw), fps), "in_frame", "event_no")
            .select("game_id", "event_no", "in_frame", "out_frame", "label"))


def _events(clean: DataFrame, fps: int, *more: Column) -> DataFrame:
    frames = seconds_to_frames(F.col("_win"), fps)
    point = (F.upper(F.col("_name")) == "REPLAY") | frames.isNull()
    length = F.when(point, F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), frames))
    return clean.select(
        "game_id", "seq", F.col("_frame").alias("in_frame"), (F.col("_frame") + length).alias("out_frame"),
        marker_label(F.col("_color"), F.col("_name"), F.col("_note")).alias("label"), *more)


def documents(raw: DataFrame, fps: int, project: str, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of FCPXML and cut list of raw marker rows, which are parsed and numbered once for both."""
    clean = cut(number_by_frame(_clean(raw, _duration()), "_frame", "_no"))
    number = F.col("_no")
    return fcpxml_lines(_typed(clean, fps, number), fps, project), edl_lines(_events(clean, fps, number.alias("event_no")), fps, games=games)


# Interchange lines -------------------------------------------------------------------------------

def _lines(df: DataFrame, first: Column, texts: list[Column]) -> DataFrame:
    """Unfold several lines per row, numbered from `first`."""
    return (df.select("game_id", first.alias("_first"), F.posexplode(F.array(*texts)).alias("_at", "line"))
            .select("game_id", (F.col("_first") + F.col("_at")).cast("long").alias("line_no"), "line"))


def edl_lines(events: DataFrame, fps: int, tc_start: str = EDL_START, games: DataFrame | None = None) -> DataFrame:
    """(game_id, line_no, line) of a cut list. Games in `games` without events still get the header."""
    known = (events if games is None else games).select("game_id").distinct()
    header = _lines(known, F.lit(1), [F.lit(EDL_TITLE), F.lit(EDL_FRAME_MODE), F.lit("")])
    offset = tc_to_frames(F.lit(tc_start), fps)
    tc_in = frames_to_tc(F.col("in_frame") + offset, fps)
    tc_out = frames_to_tc(F.col("out_frame") + offset, fps)
    number = F.format_string("%03d", F.col("event_no"))
    body = _lines(events, F.lit(4) + (F.col("event_no") - 1) * 4, [
        F.format_string(EDL_CUT, number, tc_in, tc_out, tc_in, tc_out),
        F.concat(F.lit("* LOC: "), tc_in, F.lit("  NAME: "), F.col("label")),
        F.concat(F.lit("* COMMENT: "), F.col("label")),
        F.lit("")])
    return header.unionByName(body)


def fcpxml_lines(markers: DataFrame, fps: int, project: str = XML_PROJECT) -> DataFrame:
    """(game_id, line_no, line) of one FCPXML 1.4 document per game; five seconds of tail. Markers may bring their number, `_no`."""
    total = markers.groupBy("game_id").agg(F.max("frame").alias("last"), F.count(F.lit(1)).alias("n"))
    length = rational_time(F.col("last") + F.lit(XML_TAIL_S * fps), fps)
    # The document frame.
    head = [
        F.lit('<?xml version="1.0" encoding="UTF-8"?>'),
        F.lit('<fcpxml version="1.4">'),
        F.lit('  <resources>'),
        F.lit(f'    <format id="r1" name="FFVideoFormat1080p{fps}" frameDuration="1/{fps}s" '
              'width="1920" height="1080" colorSpace="1-1-1 (Rec. 709)"/>'),
        F.lit('  </resources>'),
        F.lit('  <library>'),
        F.lit('    <event name="markers">'),
        F.concat(F.lit('      <project name="'), xml_escape(F.lit(project)), F.lit('">')),
        F.concat(F.lit('        <sequence format="r1" duration="'), length, F.lit('" tcStart="0s" tcFormat="NDF">')),
        F.lit('          <spine>'),
        F.concat(F.lit('            <gap name="Markers" offset="0s" start="0s" duration="'), length, F.lit('">')),
    ]
    foot = [F.lit(text) for text in (
        '            </gap>', '          </spine>', '        </sequence>', '      </project>',
        '    </event>', '  </library>', '</fcpxml>')]
    tagged = tag_note(F.when(F.length(strip(F.col("color"))) > 0, strip(F.col("color"))).otherwise(F.lit("Blue")), F.col("note"))
    marker = F.concat(
        F.lit('              <marker start="'), rational_time(F.col("frame"), fps),
        F.lit('" duration="'), rational_time(F.col("duration"), fps),
        F.lit('" value="'), xml_escape(F.col("name")), F.lit('" note="'), xml_escape(tagged), F.lit('"/>'))
    body = markers if "_no" in markers.columns else number_by_frame(markers, "frame", "_no")
    return (_lines(total, F.lit(1), head)
            .unionByName(_lines(body, F.lit(len(head)) + F.col("_no"), [marker]))
            .unionByName(_lines(total, F.lit(len(head) + 1) + F.col("n"), foot)))

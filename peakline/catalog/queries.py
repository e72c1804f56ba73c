"""One query per operator over the driver tables.

`COLUMNS` names the result columns and their kinds (i integer, f and g double rounded to six and
nine decimals, s text, b flag); queries and SQL are cast to it alike. Queries of a single detector step start from
the tables of the steps before it, which are computed once per session and scale.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakline.catalog import fixtures as X
from peakline.config import DetectConfig
from peakline.functions import text as TX
from peakline.functions import timecode as TC
from peakline.functions.color import color_class, color_rank
from peakline.operators import extract as EX
from peakline.operators import markers as M
from peakline.operators import scoring as S
from peakline.operators import signals as SG
from peakline.operators import timeline as TL
from peakline.operators import windows as WN
from peakline.operators.chunks import CHUNK, SERIES, attach_by_chunk, floor_div, number_rows
from peakline.operators.cut import checkpoint_folder, cut
from peakline.operators.peaks import local_maxima, peaks_above, suppress_by_distance
from peakline.plans import detect as D
from peakline.plans.batch import HEADERS, run_game_batch
from peakline.plans.extract import extract_frame_signals
from peakline.plans.extract import extract_signals as extract
from peakline.sources import rois as R
from peakline.sources import tables as TB

CFG = X.CFG
FPS60 = CFG.timeline_fps
Query = Callable[[SparkSession, str], DataFrame]

COLUMNS: dict[str, str] = {}
QUERIES: dict[str, Query] = {}


def query(columns: str) -> Callable[[Query], Query]:
    """Register a query under its function name."""
    def register(build: Query) -> Query:
        kinds = [c.split(":") for c in columns.split()]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            cast = {"i": lambda c: c.cast("long"), "f": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0), "g": lambda c: F.round(c.cast("double"), 9) + F.lit(0.0),
                    "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
            return df.select(*[cast[k](F.col(c)).alias(c) for c, k in kinds])

        COLUMNS[build.__name__] = columns
        QUERIES[build.__name__] = run
        return run
    return register


_tables: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = build()
    return _tables[key]


def _signals(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "signals", lambda: X.signals(spark, sf_dir))


def _detection(spark, sf_dir) -> D.Detection:
    return _once(spark, sf_dir, "detection", lambda: D.run_detection(_signals(spark, sf_dir), CFG, 2))


def _smooth(spark, sf_dir) -> DataFrame:
    return _detection(spark, sf_dir).attack.samples.select(*SERIES, "idx", "smooth")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _position(df: DataFrame, *more: str) -> DataFrame:
    """Row number within the game in the order of `seq`."""
    return number_rows(df, ["game_id", *more], [("_block", floor_div(F.col("seq"), 65536))], ["seq"], "pos")


# Sources and sinks -------------------------------------------------------------------------------

@query("game_id:i cam:i roi:s x:i y:i w:i h:i")
def read_rois(spark, sf_dir):
    """Documents are written first, one per line; a game may lack rectangles."""
    rois = X.rois(spark, sf_dir)
    rect = F.array(*[F.col(c).cast("double") for c in "xywh"])

    def corner(cam, roi):
        return F.first(F.when((F.col("cam") == cam) & (F.col("roi") == roi), rect), ignorenulls=True).alias(roi)

    docs = rois.groupBy(F.col("game_id").cast("string").alias("game_id")).agg(
        F.struct(corner(1, "net"), corner(1, "slot")).alias("camera_1"), F.struct(corner(2, "net"), corner(2, "slot")).alias("camera_2"))
    path = _scratch(spark, "rois")
    docs.write.json(path)
    return R.read_rois(spark, path, multi_line=False, strict=False)


@query("game_id:i cam:i roi:s x:i y:i w:i h:i")
def clamp_rois(spark, sf_dir):
    return R.clamp_rois(X.rois(spark, sf_dir), 1920, 1080)


@query("l_orderkey:i l_linenumber:i x:i y:i w:i h:i")
def rects_from_corners(spark, sf_dir):
    return R.rects_from_corners(X.corners(spark, sf_dir), 1920, 1080)


@query("game_id:i")
def complete_rois(spark, sf_dir):
    return R.complete_rois(X.rois_with_holes(spark, sf_dir))


@query("folder:s cam1:s cam2:s")
def pair_sources(spark, sf_dir):
    return R.pair_sources(X.paths(spark, sf_dir))


@query("game_id:i cam:i idx:i net:f slot:f audio:f")
def sample_to_grid(spark, sf_dir):
    return X.event_grid(spark, sf_dir)


@query("game_id:i pos:i Frame:s Name:s Note:s Color:s Duration:s")
def read_markers(spark, sf_dir):
    """The raw rows are written as CSV first; reading drops rows whose frame is not a number."""
    path = _scratch(spark, "raw-markers")
    TB._write_ordered(X.markers_raw(spark, sf_dir), ["seq"], ["seq"], "csv", path, header=True, quote='"', escape='"', emptyValue="")
    return _position(TB.read_markers(spark, path))


@query("game_id:i pos:i line:s")
def write_events(spark, sf_dir):
    """The lines of the written files in their order, without headers."""
    path = _scratch(spark, "events")
    TB.write_events(_detection(spark, sf_dir).scored, path)
    return _position(_written_lines(spark, path).filter(F.col("line") != ",".join(TB.EVENT_HEADER)))


@query("game_id:i pos:i Frame:i Name:s Note:s Color:s Duration:i")
def write_markers(spark, sf_dir):
    path = _scratch(spark, "markers")
    TB.write_markers(D.markers_of(_detection(spark, sf_dir).scored, CFG), path)
    return _position(TB.read_markers(spark, path))


@query("game_id:i line_no:i line:s")
def fcpxml_lines(spark, sf_dir):
    return M.fcpxml_lines(X.markers(spark, sf_dir), FPS60)


@query("game_id:i line_no:i line:s")
def edl_lines(spark, sf_dir):
    return M.edl_lines(M.to_edl_events(X.markers_raw(spark, sf_dir), FPS60), FPS60)


# Extraction and conditioning ---------------------------------------------------------------------

@query("game_id:i cam:i idx:i cur_sum:i prev_sum:i cur_first:i prev_last:i")
def prev_frame_pairs(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return EX.prev_frame_pairs(X.frames(spark, sf_dir)).select(
        *SERIES, "idx", total("pixels").alias("cur_sum"), total("prev_pixels").alias("prev_sum"),
        F.element_at("pixels", 1).alias("cur_first"), F.element_at("prev_pixels", 64).alias("prev_last"))


@query("game_id:i cam:i idx:i net:f slot:f full:f")
def framediff_energy(spark, sf_dir):
    frames = X.frames(spark, sf_dir)
    return EX.framediff_energy(frames, X.frame_rois(frames))


@query("game_id:i cam:i idx:i net:f slot:f")
def roi_mean_motion(spark, sf_dir):
    motion = X.motion(spark, sf_dir)
    return EX.roi_mean_motion(motion, X.frame_rois(motion))


@query("game_id:i cam:i k:i t:f rms:f")
def audio_rms(spark, sf_dir):
    return EX.audio_rms(X.audio(spark, sf_dir), X.RATE)


def _interp(spark, sf_dir):
    audio = X.audio(spark, sf_dir)
    lengths = cut(audio.groupBy(*SERIES).agg(F.floor(F.count(F.lit(1)) / F.lit(X.RATE) * 12).cast("long").alias("n")))
    return EX.interp_to_grid(EX.audio_rms(audio, X.RATE), EX.series_grid(lengths), fps=12)


@query("game_id:i cam:i idx:i rms:f")
def interp_to_grid(spark, sf_dir):
    return _interp(spark, sf_dir)


@query("game_id:i cam:i idx:i amount:f")
def interp_to_grid_events(spark, sf_dir):
    """Points at irregular times, several at once and with long gaps: the events themselves, onto the ten-minute grid. Half a millionth rounds to even."""
    found = EX.interp_to_grid(X.event_points(spark, sf_dir), X.event_grid(spark, sf_dir), fps=1.0 / X.BIN_S, value="amount", time="t_s")
    return found.withColumn("amount", F.rint(F.col("amount") * F.lit(1e6)) / F.lit(1e6))


@query("game_id:i cam:i idx:i net:f slot:f audio:f")
def audio_or_zeros(spark, sf_dir):
    return EX.audio_or_zeros(_signals(spark, sf_dir), _interp(spark, sf_dir))


@query("game_id:i cam:i idx:i flow:f")
def blend_rois(spark, sf_dir):
    return SG.blend_rois(_signals(spark, sf_dir))


@query("game_id:i cam:i idx:i flow_norm:f")
def normalize_p99(spark, sf_dir):
    return SG.normalize_p99(SG.blend_rois(_signals(spark, sf_dir)), "flow")


@query("game_id:i cam:i idx:i raw:f")
def fuse_signals(spark, sf_dir):
    return SG.fuse_signals(_signals(spark, sf_dir))


@query("game_id:i cam:i idx:i smooth:g")
def moving_average(spark, sf_dir):
    return SG.moving_average(SG.fuse_signals(_signals(spark, sf_dir)), CFG.smooth_win, chunk=CFG.segment_samples)


@query("game_id:i cam:i idx:i threshold:f")
def rolling_threshold(spark, sf_dir):
    return SG.rolling_threshold(_smooth(spark, sf_dir), CFG.fps, CFG.thresh_pct)


@query("game_id:i cam:i idx:i threshold:f")
def global_threshold(spark, sf_dir):
    smooth = SG.moving_average(SG.blend_rois(_signals(spark, sf_dir)), CFG.smooth_win, col="flow")
    return SG.global_threshold(smooth, CFG.thresh_pct)


# Peaks, windows, scoring -------------------------------------------------------------------------

@query("game_id:i cam:i idx:i left:i right:i value:g")
def local_maxima_query(spark, sf_dir):
    return local_maxima(_smooth(spark, sf_dir), chunk=CFG.segment_samples)


@query("game_id:i cam:i idx:i value:g")
def peaks_above_query(spark, sf_dir):
    levels = SG.rolling_threshold(_smooth(spark, sf_dir), CFG.fps, CFG.thresh_pct).select(*SERIES, "idx", "threshold")
    tops = local_maxima(_smooth(spark, sf_dir), chunk=CFG.segment_samples)
    return peaks_above(tops.join(levels, [*SERIES, "idx"]), "threshold")


@query("game_id:i cam:i idx:i value:g")
def suppress_by_distance_query(spark, sf_dir):
    return suppress_by_distance(_detection(spark, sf_dir).candidates, CFG.peak_distance)


@query("game_id:i cam:i idx:i peak_s:f peak_val:g start_s:f end_s:f")
def peak_windows(spark, sf_dir):
    return D.peak_windows(_signals(spark, sf_dir), CFG)


@query("game_id:i cam:i start_s:f end_s:f")
def union_cameras(spark, sf_dir):
    peaks = _detection(spark, sf_dir).peaks
    return WN.union_cameras(peaks.filter(F.col("cam") == 1), peaks.filter(F.col("cam") == 2))


@query("game_id:i window_id:i start_s:f end_s:f")
def merge_intervals(spark, sf_dir):
    return WN.merge_intervals(_detection(spark, sf_dir).peaks, CFG.merge_gap_s)


@query("game_id:i window_id:i start_s:f end_s:f")
def sanitize_windows(spark, sf_dir):
    return WN.sanitize_windows(_detection(spark, sf_dir).merged)


@query("game_id:i window_id:i cam:i idx:i smooth:g")
def window_samples(spark, sf_dir):
    run = _detection(spark, sf_dir)
    return S.window_samples(S.window_pieces(run.windows, CFG), run.attack.samples, CFG)


@query("game_id:i window_id:i cam:i n:i max_attack:g argmax:i")
def window_max(spark, sf_dir):
    run = _detection(spark, sf_dir)
    return S.window_max(run.windows, S.window_samples(run.pieces, run.attack.samples, CFG))


@query("game_id:i window_id:i cam:i rebound:f")
def window_rebound(spark, sf_dir):
    return _detection(spark, sf_dir).rebounds


@query("game_id:i window_id:i cam:i drop:g")
def window_drop(spark, sf_dir):
    run = _detection(spark, sf_dir)
    return S.window_stats(S.window_samples(run.pieces, run.attack.samples, CFG))


@query("game_id:i window_id:i m1:g m2:g primary_cam:i conf:f")
def choose_camera(spark, sf_dir):
    run = _detection(spark, sf_dir)
    return S.choose_camera(run.windows, run.stats)


@query("game_id:i window_id:i score:f")
def score_windows(spark, sf_dir):
    run = _detection(spark, sf_dir)
    return S.score_windows(S.choose_camera(run.windows, run.rebounds), CFG)


@query("game_id:i cam:i p99:f")
def series_p99(spark, sf_dir):
    smooth = _smooth(spark, sf_dir)
    return SG.series_p99(smooth, cameras=smooth)


@query("game_id:i window_id:i color:s rank:i")
def color_class_query(spark, sf_dir):
    return (_detection(spark, sf_dir).before_cooldown.withColumn("color", color_class(F.col("score")))
            .withColumn("rank", color_rank(F.col("color"))))


@query("game_id:i window_id:i start_s:f end_s:f color:s")
def cap_duration(spark, sf_dir):
    return WN.cap_duration(_detection(spark, sf_dir).judged, CFG)


@query("game_id:i window_id:i start_s:f end_s:f score:f")
def cooldown(spark, sf_dir):
    return WN.cooldown(_detection(spark, sf_dir).before_cooldown, CFG.cooldown_s)


@query("game_id:i seq:i frame:i name:s note:s color:s duration:i")
def to_markers(spark, sf_dir):
    return M.to_markers(_detection(spark, sf_dir).scored, FPS60)


@query("game_id:i seq:i frame:i name:s note:s color:s duration:i")
def replay_markers(spark, sf_dir):
    return M.replay_markers(_detection(spark, sf_dir).scored, CFG)


@query("game_id:i peaks_cam1:i peaks_cam2:i windows:i events_before_cooldown:i events_after_cooldown:i markers:i")
def detection_summary(spark, sf_dir):
    return D.detection_summary(_detection(spark, sf_dir), CFG)


@query("game_id:i cam:i idx:i t_s:f signal:g threshold:f is_peak:b")
def debug_series(spark, sf_dir):
    run = _detection(spark, sf_dir)
    return D.debug_series(D.sample_levels(run.attack), run.peaks, CFG)


@query("game_id:i window_id:i score:f rank:i")
def rank_events(spark, sf_dir):
    return S.rank_events(_detection(spark, sf_dir).scored, top=5)


# Marker tables -----------------------------------------------------------------------------------

@query("game_id:i event_no:i frames:i")
def tc_to_frames(spark, sf_dir):
    events = M.to_edl_events(X.markers_raw(spark, sf_dir), FPS60)
    tc = TC.frames_to_tc(F.col("in_frame") + TC.tc_to_frames(F.lit(M.EDL_START), FPS60), FPS60)
    return events.withColumn("frames", TC.tc_to_frames(tc, FPS60))


@query("game_id:i event_no:i tc:s")
def frames_to_tc(spark, sf_dir):
    return M.to_edl_events(X.markers_raw(spark, sf_dir), FPS60).withColumn("tc", TC.frames_to_tc(F.col("in_frame"), FPS60))


@query("game_id:i seq:i win_s:f")
def parse_win_seconds(spark, sf_dir):
    return X.markers(spark, sf_dir).withColumn("win_s", TX.parse_win_seconds(F.col("note")))


@query("game_id:i seq:i color:s")
def parse_color(spark, sf_dir):
    return X.markers_raw(spark, sf_dir).select("game_id", "seq", TX.parse_color(F.col("Name"), F.col("Note")).alias("color"))


@query("game_id:i seq:i angle:i")
def parse_cam_angle(spark, sf_dir):
    return X.markers_raw(spark, sf_dir).select("game_id", "seq", TX.parse_cam_angle(F.col("Name"), F.col("Note")).alias("angle"))


@query("game_id:i seq:i frame:i name:s note:s color:s duration:i")
def normalize_markers(spark, sf_dir):
    return M.normalize_markers(X.markers_raw(spark, sf_dir), FPS60)


@query("game_id:i event_no:i in_frame:i out_frame:i label:s")
def to_edl_events(spark, sf_dir):
    return M.to_edl_events(X.markers_raw(spark, sf_dir), FPS60)


@query("game_id:i seq:i label:s")
def marker_label(spark, sf_dir):
    """Notes are padded so that many labels pass the length limit."""
    raw = X.markers_raw(spark, sf_dir).filter(M.whole_number(F.col("Frame")).isNotNull())
    note = F.concat(F.col("Note"), F.repeat(F.lit("+"), (F.col("seq") % 120).cast("int")))
    return raw.select("game_id", "seq", TX.marker_label(F.col("Color"), F.col("Name"), note).alias("label"))


@query("game_id:i seq:i start:s length:s")
def rational_time(spark, sf_dir):
    return X.markers(spark, sf_dir).select("game_id", "seq", TC.rational_time(F.col("frame"), FPS60).alias("start"),
                                           TC.rational_time(F.col("duration"), FPS60).alias("length"))


@query("game_id:i seq:i escaped:s")
def xml_escape(spark, sf_dir):
    return X.markers(spark, sf_dir).withColumn("escaped", TX.xml_escape(F.col("note")))


@query("game_id:i seq:i note:s")
def tag_note(spark, sf_dir):
    return X.markers(spark, sf_dir).withColumn("note", TX.tag_note(F.col("color"), F.col("note")))


@query("game_id:i seq:i frame:i name:s note:s color:s duration:i start_frame:i end_frame:i angle:i")
def expand_markers(spark, sf_dir):
    return TL.expand_markers(X.markers(spark, sf_dir), FPS60, 3600)


@query("game_id:i expanded:i skipped:i")
def expansion_counts(spark, sf_dir):
    return TL.expansion_counts(X.markers(spark, sf_dir))


@query("game_id:i frame:i")
def split_points(spark, sf_dir):
    return TL.split_points(TL.expand_markers(X.markers(spark, sf_dir), FPS60, 3600))


@query("game_id:i clip_id:i start_frame:i end_frame:i")
def split_clips(spark, sf_dir):
    markers = X.markers(spark, sf_dir)
    return TL.split_clips(X.clips(markers), TL.split_points(TL.expand_markers(markers, FPS60, 3600)))


@query("game_id:i clip_id:i start_frame:i end_frame:i angle:i")
def assign_angles(spark, sf_dir):
    """Every fifth clip is there twice."""
    markers = X.markers(spark, sf_dir)
    clips = X.clips(markers)
    return TL.assign_angles(clips.unionByName(clips.filter(F.col("clip_id") % 5 == 0)), cut(TL.expand_markers(markers, FPS60, 3600)))


@query("game_id:i frame:i color:s name:s note:s duration:i")
def merge_markers(spark, sf_dir):
    return TL.merge_markers(*X.merge_sides(X.markers(spark, sf_dir)))


@query("game_id:i copied:i skipped:i")
def merge_counts(spark, sf_dir):
    return TL.merge_counts(*X.merge_sides_of_all(X.markers(spark, sf_dir)))


@query("game_id:i frame:i color:s name:s note:s duration:i")
def replace_markers(spark, sf_dir):
    """The source covers every second game; the others keep their markers."""
    return TL.replace_markers(*X.merge_sides(X.markers(spark, sf_dir)))


# Composites --------------------------------------------------------------------------------------

_EVENTS = "game_id:i window_id:i start_s:f end_s:f score:f primary_cam:i conf:f color:s"


@query(_EVENTS)
def detect_v1(spark, sf_dir):
    return D.detect_v1(X.signals(spark, sf_dir), CFG)


@query(_EVENTS)
def detect_v2(spark, sf_dir):
    return D.detect_v2(X.signals(spark, sf_dir), CFG)


@query(_EVENTS)
def detect_v2_defaults(spark, sf_dir):
    """The plain defaults at 12 samples a second: wide smoothing, a gap in merging, no cooldown."""
    return D.detect_v2(X.signals(spark, sf_dir), DetectConfig())


def _extracted(spark, sf_dir):
    """Rectangles are given for a picture of twice the size; the second camera has no audio."""
    motion = X.motion(spark, sf_dir)
    return extract(motion, X.frame_rois(motion, 2), CFG, X.audio(spark, sf_dir), X.RATE, 0.5)


@query("game_id:i cam:i idx:i net:f slot:f audio:f")
def extract_signals(spark, sf_dir):
    return _extracted(spark, sf_dir)


@query(_EVENTS)
def detect_from_motion(spark, sf_dir):
    return D.detect_v2(cut(_extracted(spark, sf_dir)), CFG)


@query(_EVENTS)
def detect_from_frames(spark, sf_dir):
    """Frames of one byte per pixel, through the first detector."""
    frames = X.byte_frames(spark, sf_dir)
    return D.detect_v1(cut(extract_frame_signals(frames, X.frame_rois(frames))), CFG)


@query("game_id:i cam:i idx:i net:f slot:f full:f")
def framediff_energy_bytes(spark, sf_dir):
    frames = X.byte_frames(spark, sf_dir)
    return EX.framediff_energy(frames, X.frame_rois(frames))


@query("game_id:i frame:i color:s name:s note:s duration:i")
def merge_markers_all(spark, sf_dir):
    """Merging without removing repeats."""
    return TL.merge_markers(*X.merge_sides(X.markers(spark, sf_dir)), dedupe=False)


@query(_EVENTS)
def detect_v2_one_camera(spark, sf_dir):
    """Odd games lack the second camera."""
    signals = X.signals(spark, sf_dir)
    return D.detect_v2(signals.filter((F.col("cam") == 1) | (F.col("game_id") % 2 == 0)), CFG)


@query("game_id:i seq:i frame:i name:s note:s color:s duration:i")
def markers_v2(spark, sf_dir):
    return D.markers_v2(X.signals(spark, sf_dir), CFG)


def _written_lines(spark, path: str, *folders: str) -> DataFrame:
    """(game_id, seq, line) of text files, in the order of the part numbers and of the lines in them."""
    part = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select("game_id", *folders, (F.shiftleft(part, 36) + F.col("_metadata.file_block_start") + row).alias("seq"), F.col("value").alias("line"))


@query("game_id:i kind:s pos:i line:s")
def run_game_batch_query(spark, sf_dir):
    """Every line the run writes, in order; a table's header has position 0. Game -1 has samples and no events."""
    quiet = spark.range(200).select(F.lit(-1).alias("game_id"), (F.col("id") % 2 + 1).cast("int").alias("cam"), F.floor(F.col("id") / 2).alias("idx"),
                                    *[F.lit(0.0).alias(c) for c in ("net", "slot", "audio")])
    paths = run_game_batch(spark, X.signals(spark, sf_dir).unionByName(quiet), _scratch(spark, "batch"), CFG)
    lines = cut(_written_lines(spark, paths["events"].rpartition("/")[0], "kind"))
    header = F.coalesce(*[F.when(F.col("kind") == kind, F.col("line") == text) for kind, text in HEADERS.items()], F.lit(False))
    body = _position(lines.filter(~header), "kind").select("game_id", "kind", "pos", "line")
    return body.unionByName(lines.filter(header).select("game_id", "kind", F.lit(0).cast("long").alias("pos"), "line").distinct())


@query("game_id:i clip_id:i start_frame:i end_frame:i angle:i")
def conform_timeline(spark, sf_dir):
    markers = X.markers(spark, sf_dir)
    return D.conform_timeline(markers, X.clips(markers), FPS60, 3600)


# Functions whose own name is taken by the operator they call.
for _name in [n for n in QUERIES if n.endswith("_query")]:
    QUERIES[_name.removesuffix("_query")] = QUERIES.pop(_name)
    COLUMNS[_name.removesuffix("_query")] = COLUMNS.pop(_name)

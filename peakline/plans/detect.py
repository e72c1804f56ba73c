"""The two detectors and what follows them, over many games at once.

Tables that several later steps read (the per-sample profile, the peaks, the windows and their
statistics) are cut: computed once into the session's checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakline.config import DetectConfig
from peakline.operators import markers as M
from peakline.operators import scoring as S
from peakline.operators import timeline as TL
from peakline.operators import windows as WN
from peakline.operators.chunks import CHUNK, SERIES, attach_by_chunk, group_sizes
from peakline.operators.cut import cut, measured
from peakline.operators.peaks import open_tops, tops_of
from peakline.operators.percentiles import exact_percentiles, percentile_name
from peakline.operators.signals import attack_profile, segment_of

MIN_SAMPLES = 10


@dataclass(frozen=True)
class Attack:
    """The per-sample profile, its local maxima and the scalars of each series (n, level, p99).

    `level` is the threshold of the whole series (version 1) or its floor (version 2); `far` counts the tops whose middle lies in another
    segment than their end.
    """

    samples: DataFrame
    tops: DataFrame
    scalars: DataFrame
    series: int
    far: int


def prepare(signals: DataFrame, cfg: DetectConfig, version: int) -> Attack:
    longest, series = group_sizes(signals, SERIES)
    samples, seen = measured(attack_profile(signals, cfg, fused=version == 2, longest=longest, series=series), open_tops=open_tops())
    pct = cfg.floor_pct if version == 2 else cfg.thresh_pct
    scalars = exact_percentiles(samples.select(*SERIES, CHUNK, "smooth"), {"smooth": [pct, 99.0]}, longest=longest)
    scalars = scalars.select(*SERIES, "last_chunk", F.col("smooth_n").alias("series_n"),
                             F.col(percentile_name("smooth", pct)).alias("level"),
                             F.col(percentile_name("smooth", 99.0)).alias("p99"))
    tops, found = measured(tops_of(samples, seen["open_tops"], "smooth", ("segment_level",), longest // cfg.segment_samples + 1),
                           far=F.count_if(_elsewhere(cfg)))
    return Attack(samples, tops, scalars, series, found["far"])


def _elsewhere(cfg: DetectConfig):
    return segment_of(F.col("idx"), cfg) != F.col(CHUNK)


def peak_candidates(attack: Attack, cfg: DetectConfig, version: int) -> DataFrame:
    """Local maxima at or above their threshold, of series with enough samples.

    The segment's own percentile is already in the profile and removes nearly all maxima before
    anything is joined; only flat tops whose middle lies in another segment look theirs up.
    """
    tops = attack.tops
    if version == 2:
        elsewhere = _elsewhere(cfg)
        own = tops.filter(~elsewhere & (F.col("value") >= F.col("segment_level"))).drop("segment_level")
        if attack.far:
            far = tops.filter(elsewhere).drop("segment_level")
            levels = attack.samples.groupBy(*SERIES, CHUNK).agg(F.max("segment_level").alias("segment_level"))
            far = (far.withColumn(CHUNK, segment_of(F.col("idx"), cfg)).join(levels, [*SERIES, CHUNK])
                   .filter(F.col("value") >= F.col("segment_level")).drop("segment_level"))
            own = own.unionByName(far)
        tops = own
    return (attach_by_chunk(tops, attack.scalars, SERIES, "last_chunk", attack.series)
            .filter((F.col("series_n") >= MIN_SAMPLES) & (F.col("value") >= F.col("level")))
            .select(*SERIES, "idx", "value"))


class Detection:
    """The tables of one detection run. Each is computed when it is first asked for, with the steps before it, and kept."""

    def __init__(self, signals: DataFrame, cfg: DetectConfig, version: int):
        self.signals, self.cfg, self.version = signals, cfg, version

    @cached_property
    def attack(self) -> Attack:
        return prepare(self.signals, self.cfg, self.version)

    @cached_property
    def candidates(self) -> DataFrame:
        return peak_candidates(self.attack, self.cfg, self.version)

    @cached_property
    def peaks(self) -> DataFrame:
        return WN.spaced_peak_windows(self.candidates, self.cfg)

    @cached_property
    def merged(self) -> DataFrame:
        return cut(WN.merge_intervals(self.peaks, self.cfg.merge_gap_s))

    @cached_property
    def windows(self) -> DataFrame:
        return WN.sanitize_windows(self.merged, self.cfg.min_window_s)

    @cached_property
    def pieces(self) -> DataFrame:
        """The windows' ranges of samples per camera and chunk, with the P99 of the series."""
        p99 = self.attack.scalars.select(*SERIES, "last_chunk", "p99")
        return cut(attach_by_chunk(S.window_pieces(self.windows, self.cfg), p99, SERIES, "last_chunk", self.attack.series))

    @cached_property
    def stats(self) -> DataFrame:
        samples = self.attack.samples.select(*SERIES, CHUNK, "idx", "smooth", "fwd_min")
        return cut(S.window_stats(S.window_samples(self.pieces, samples, self.cfg), extra=("p99",)))

    @cached_property
    def rebounds(self) -> DataFrame:
        """`stats` with the rebound."""
        return S.window_rebound(self.pieces, self.attack.tops, self.stats, self.cfg)

    @cached_property
    def judged(self) -> DataFrame:
        """The windows with camera, score and colour, before any is shortened or dropped."""
        return WN.with_color(S.score_windows(S.choose_camera(self.windows, self.rebounds), self.cfg))

    @cached_property
    def before_cooldown(self) -> DataFrame:
        return cut(WN.cap_duration(self.judged, self.cfg).select("game_id", "window_id", "start_s", "end_s", "score", "primary_cam", "conf", "color"))

    @cached_property
    def scored(self) -> DataFrame:
        return WN.cooldown(self.before_cooldown, self.cfg.cooldown_s)


def run_detection(signals: DataFrame, cfg: DetectConfig, version: int) -> Detection:
    return Detection(signals, cfg, version)


def detect_v1(signals: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Blend, smooth, one threshold per series; no scaling before the peaks and no audio.

    The first detector scores with its own fixed weights, whatever the configuration says.
    """
    fixed = cfg.replace(w_attack=0.55, w_rebound=0.25, w_drop=0.20)
    return run_detection(signals, fixed, 1).scored


def detect_v2(signals: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Scale and fuse flow and audio, smooth, threshold per segment with a floor."""
    return run_detection(signals, cfg, 2).scored


def markers_of(scored: DataFrame, cfg: DetectConfig) -> DataFrame:
    return M.replay_markers(scored, cfg) if cfg.replay_markers else M.to_markers(scored, cfg.timeline_fps)


def markers_v2(signals: DataFrame, cfg: DetectConfig) -> DataFrame:
    return markers_of(detect_v2(signals, cfg), cfg)


def peak_windows(signals: DataFrame, cfg: DetectConfig, version: int = 2) -> DataFrame:
    """Peaks of each camera with their windows."""
    return WN.spaced_peak_windows(peak_candidates(prepare(signals, cfg, version), cfg, version), cfg)


def detection_summary(run: Detection, cfg: DetectConfig) -> DataFrame:
    """Counters per game: peaks of each camera, windows, events around the cooldown, markers."""
    def tagged(df: DataFrame, *flags) -> DataFrame:
        names = ("peaks_cam1", "peaks_cam2", "windows", "events_before_cooldown", "events_after_cooldown", "markers")
        marks = dict(flags)
        return df.select("game_id", *[marks.get(n, F.lit(0)).cast("long").alias(n) for n in names])

    one = F.lit(1)
    rows = (tagged(run.peaks, ("peaks_cam1", F.col("cam") == 1), ("peaks_cam2", F.col("cam") == 2))
            .unionByName(tagged(run.merged, ("windows", one)))
            .unionByName(tagged(run.before_cooldown, ("events_before_cooldown", one)))
            .unionByName(tagged(run.scored, ("events_after_cooldown", one)))
            .unionByName(tagged(markers_of(run.scored, cfg), ("markers", one))))
    return rows.groupBy("game_id").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "game_id"])


def sample_levels(attack: Attack) -> DataFrame:
    """Every sample with the threshold it was held against: the one of its segment, at least that of its series."""
    samples = attack.samples.select(*SERIES, CHUNK, "idx", "smooth", "segment_level")
    levels = attack.scalars.select(*SERIES, "last_chunk", "level")
    return (attach_by_chunk(samples, levels, SERIES, "last_chunk", attack.series)
            .select(*SERIES, "idx", "smooth", F.greatest("segment_level", "level").alias("threshold")))


def debug_series(attack: DataFrame, peaks: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Time, signal, threshold and peak flag of every sample."""
    marks = peaks.select(*SERIES, "idx", F.lit(True).alias("_peak"))
    return (attack.join(marks, [*SERIES, "idx"], "left")
            .select(*SERIES, "idx", (F.col("idx") / F.lit(cfg.fps)).alias("t_s"), F.col("smooth").alias("signal"),
                    "threshold", F.coalesce("_peak", F.lit(False)).alias("is_peak")))


def conform_timeline(markers: DataFrame, clips: DataFrame, fps: float, start_frame: int = 0) -> DataFrame:
    """Expand markers to ranges, cut the clips at their ends, set the angle of every piece."""
    ranges = cut(TL.expand_markers(markers, fps, start_frame))
    return TL.assign_angles(TL.split_clips(clips, TL.split_points(ranges)), ranges)

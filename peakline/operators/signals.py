"""Conditioning of sampled signals: blend, scale, fuse, smooth, adaptive thresholds.

Signals are rows (game_id, cam, idx, ...) with idx dense from 0. Values are doubles; smoothed
values are rounded to nine decimals so that equal samples stay equal whatever the summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakline.config import DetectConfig
from peakline.operators.chunks import (
    CHUNK, DEFAULT_CHUNK, HOME, SERIES, attach_by_chunk, chunk_window, dealt, floor_div, with_chunk, with_halo)
from peakline.operators.peaks import mark_tops
from peakline.operators.percentiles import exact_percentiles, percentile_name

EPS = 1e-6


def round9(col: Column) -> Column:
    return F.rint(col * F.lit(1e9)) / F.lit(1e9)


def blend_rois(signals: DataFrame, net_share: float = 0.7, slot_share: float = 0.3, out: str = "flow") -> DataFrame:
    return signals.withColumn(out, F.lit(net_share) * F.col("net") + F.lit(slot_share) * F.col("slot"))


def normalize_p99(df: DataFrame, col: str, out: str | None = None, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """col / (P99 of its series + 1e-6)."""
    chunked = with_chunk(df, chunk)
    scale = exact_percentiles(chunked.select(*SERIES, CHUNK, col), {col: [99]})
    p99 = percentile_name(col, 99)
    scaled = attach_by_chunk(chunked, scale.select(*SERIES, "last_chunk", p99), SERIES, "last_chunk")
    return scaled.withColumn(out or f"{col}_norm", F.col(col) / (F.col(p99) + F.lit(EPS))).drop(p99, CHUNK)


def _fused(flow_weight: float, audio_weight: float) -> Column:
    """The fused sample, given flow, audio and the per-series scalars of `_fuse_scalars`."""
    raw = F.lit(flow_weight) * (F.col("flow") / (F.col("flow_p99") + F.lit(EPS)))
    if audio_weight <= 0:
        return raw
    loud = F.lit(audio_weight) * (F.col("audio") / (F.col("audio_p99") + F.lit(EPS)))
    return F.when(F.col("audio_n") == F.col("flow_n"), raw + loud).otherwise(raw)


def _fuse_scalars(chunked: DataFrame, audio_weight: float, longest: int | None = None) -> DataFrame:
    measures = {"flow": [99]}
    if audio_weight > 0:
        measures["audio"] = [99]
    return exact_percentiles(chunked.select(*SERIES, CHUNK, *measures), measures, longest=longest)


def fuse_signals(signals: DataFrame, flow_weight: float = 0.8, audio_weight: float = 0.2,
                 net_share: float = 0.7, slot_share: float = 0.3, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds `raw`: weighted sum of the scaled flow blend and the scaled audio.

    Audio takes part only when its weight is positive and it has a value for every sample.
    """
    chunked = with_chunk(blend_rois(signals, net_share, slot_share), chunk)
    scalars = _fuse_scalars(chunked, audio_weight)
    names = [c for c in scalars.columns if c not in (*SERIES, "last_chunk")]
    fused = attach_by_chunk(chunked, scalars, SERIES, "last_chunk")
    return fused.withColumn("raw", _fused(flow_weight, audio_weight)).drop(*names, CHUNK)


def frame_rows(win: int) -> tuple[int, int]:
    """Rows before and after a sample in a centred frame of `win` rows."""
    return win // 2, win - win // 2 - 1


def _moving_average(value: str, win: int) -> Column:
    before, after = frame_rows(win)
    total = F.sum(value).over(chunk_window().rowsBetween(-before, after))
    return round9(total / F.lit(float(win)))


def moving_average(df: DataFrame, win: int, col: str = "raw", out: str = "smooth", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Centred moving sum divided by `win`, with zeros assumed outside the series."""
    if win <= 1:
        return df.withColumn(out, round9(F.col(col)))
    before, after = frame_rows(win)
    return (with_halo(df, chunk, before, after)
            .withColumn(out, _moving_average(col, win))
            .filter(HOME).drop(HOME, CHUNK))


def rolling_threshold(df: DataFrame, fps: int, pct: float, segment_s: float = 300.0, floor_pct: float = 70.0,
                      col: str = "smooth") -> DataFrame:
    """Adds `threshold`: the segment's percentile, at least the whole series' floor percentile.

    The segment is the chunk: one shuffle by (keys, segment) serves the percentile and the floor.
    """
    size = max(1, round(segment_s * fps))
    chunked = with_chunk(df.drop(CHUNK), size)
    floors = exact_percentiles(chunked.select(*SERIES, CHUNK, col), {col: [floor_pct]})
    floor = percentile_name(col, floor_pct)
    joined = attach_by_chunk(chunked, floors.select(*SERIES, "last_chunk", floor), SERIES, "last_chunk")
    segment = F.percentile(F.col(col), pct / 100.0).over(Window.partitionBy(*SERIES, CHUNK))
    return (joined.withColumn("threshold", F.greatest(segment, F.col(floor))).drop(floor, CHUNK))


def global_threshold(df: DataFrame, pct: float, col: str = "smooth", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds `threshold`: one percentile for the whole series."""
    chunked = with_chunk(df, chunk)
    level = exact_percentiles(chunked.select(*SERIES, CHUNK, col), {col: [pct]})
    name = percentile_name(col, pct)
    return (attach_by_chunk(chunked, level.select(*SERIES, "last_chunk", F.col(name).alias("threshold")), SERIES, "last_chunk")
            .drop(CHUNK))


def attack_profile(signals: DataFrame, cfg: DetectConfig, fused: bool, longest: int | None = None, series: int | None = None) -> DataFrame:
    """Everything the detectors need per sample, from one shuffle and one sort of the signals.

    Columns: smooth, fwd_min (minimum of smooth over the next `drop_samples` samples), segment_level
    (the threshold percentile of the sample's segment) and the marks of `mark_tops`.
    """
    before, after = frame_rows(cfg.smooth_win)
    ahead = max(1, cfg.drop_samples - 1)
    size = cfg.segment_samples
    audio = fused and cfg.audio_weight > 0
    blended = blend_rois(signals, cfg.net_share, cfg.slot_share).select(*SERIES, "idx", "flow", *(["audio"] if audio else []))
    spread = with_halo(blended, size, before + 1, after + ahead)
    raw = F.col("flow")
    if fused:
        scalars = _fuse_scalars(with_chunk(blended, size), cfg.audio_weight, longest)
        spread = attach_by_chunk(spread, scalars, SERIES, "last_chunk", series)
        raw = _fused(cfg.flow_weight, cfg.audio_weight)
    smooth = _moving_average("raw", cfg.smooth_win) if cfg.smooth_win > 1 else round9(F.col("raw"))
    # Smooth values are right where the whole frame is visible: one row before the chunk, `ahead` after it.
    first = F.col(CHUNK) * F.lit(size)
    whole = (F.col("idx") >= first - 1) & (F.col("idx") < first + size + ahead)
    smoothed = dealt(spread.select(*SERIES, CHUNK, HOME, "idx", raw.alias("raw")), *SERIES, CHUNK).withColumn("smooth", smooth).filter(whole)
    forward = chunk_window().rowsBetween(0, max(1, cfg.drop_samples) - 1)
    # Over the order of the others, though it needs none, so that one pass serves them all.
    every = chunk_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    segment = F.percentile(F.when(F.col(HOME), F.col("smooth")), cfg.thresh_pct / 100.0).over(every)
    # The first detector has one threshold per series.
    ahead_of = smoothed.withColumns({"fwd_min": F.min("smooth").over(forward), "segment_level": segment if fused else F.lit(None).cast("double")})
    return (mark_tops(ahead_of, "smooth")
            .filter(HOME).select(*SERIES, CHUNK, "idx", "smooth", "fwd_min", "segment_level", "rise", "left", "top"))


def series_p99(attack: DataFrame, col: str = "smooth", cameras: DataFrame | None = None,
               chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """P99 per (game, cam); a known camera without samples gets 1.0."""
    chunked = with_chunk(attack, chunk)
    p99 = exact_percentiles(chunked.select(*SERIES, CHUNK, col), {col: [99]})
    p99 = p99.select(*SERIES, F.col(percentile_name(col, 99)).alias("p99"))
    if cameras is None:
        return p99
    return cameras.select(*SERIES).distinct().join(p99, SERIES, "left").withColumn("p99", F.coalesce("p99", F.lit(1.0)))


def segment_of(idx: Column, cfg: DetectConfig) -> Column:
    return floor_div(idx, cfg.segment_samples)

"""Per-window statistics of each camera, the choice of camera and the score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakline.config import DetectConfig
from peakline.operators.chunks import CHUNK, SERIES, explode_range, floor_div, with_chunk
from peakline.operators.peaks import suppress_by_distance
from peakline.operators.signals import EPS

WINDOW_KEYS = ["game_id", "window_id", "cam"]


def window_pieces(windows: DataFrame, cfg: DetectConfig) -> DataFrame:
    """The sample range [a, b) of each window for both cameras, one row per chunk it touches."""
    a = F.greatest(F.lit(0).cast("long"), F.floor(F.col("start_s") * F.lit(cfg.fps)).cast("long"))
    b = F.ceil(F.col("end_s") * F.lit(cfg.fps)).cast("long")
    sides = (windows.select("game_id", "window_id", a.alias("a"), b.alias("b"))
             .withColumn("cam", F.explode(F.array(F.lit(1), F.lit(2)))))
    size = cfg.segment_samples
    return explode_range(sides, floor_div(F.col("a"), size), floor_div(F.col("b") - 1, size), CHUNK)


def window_samples(pieces: DataFrame, series: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Samples of each camera inside each window; a boundary sample may belong to two windows.

    Equi-join of `window_pieces` on (game, cam, chunk) with the range as a residual condition:
    merged windows do not overlap, so few windows share a chunk.
    """
    samples = with_chunk(series, cfg.segment_samples)
    inside = (F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b"))
    return samples.join(pieces, [*SERIES, CHUNK]).filter(inside)


def window_stats(samples: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Sample count, maximum, its first position and the drop after it, per window and camera.

    `fwd_min` of the series already looks past the window end. `extra` columns are constant per
    series and are passed through.
    """
    top = F.max(F.struct(F.col("smooth").alias("v"), (-F.col("idx")).alias("at"), "fwd_min"))
    return (samples.groupBy(*WINDOW_KEYS)
            .agg(F.count(F.lit(1)).alias("n"), top.alias("_top"), *[F.max(c).alias(c) for c in extra])
            .select(*WINDOW_KEYS, "n", F.col("_top.v").alias("max_attack"), (-F.col("_top.at")).alias("argmax"),
                    (F.col("_top.v") - F.col("_top.fwd_min")).alias("drop"), *extra))


def window_max(windows: DataFrame, samples: DataFrame) -> DataFrame:
    """Maximum and first position per window and camera; 0 for a camera without samples there."""
    both = windows.select("game_id", "window_id").withColumn("cam", F.explode(F.array(F.lit(1), F.lit(2))))
    top = F.max(F.struct(F.col("smooth").alias("v"), (-F.col("idx")).alias("at")))
    stats = samples.groupBy(*WINDOW_KEYS).agg(F.count(F.lit(1)).alias("n"), top.alias("_top"))
    zero = F.lit(0).cast("long")
    return (both.join(stats, WINDOW_KEYS, "left")
            .select(*WINDOW_KEYS, F.coalesce("n", zero).alias("n"), F.coalesce("_top.v", F.lit(0.0)).alias("max_attack"),
                    F.coalesce(-F.col("_top.at"), zero).alias("argmax")))


def window_rebound(pieces: DataFrame, tops: DataFrame, stats: DataFrame, cfg: DetectConfig, **how) -> DataFrame:
    """min(3, peaks >= 0.8 of the maximum, spaced) / 3 per window and camera; 0 for 5 samples or fewer.

    A peak of the slice is a peak of the series whose top and both neighbours lie in the slice, so
    the maxima (`tops`, with their chunk) are found once per series, not once per window.
    """
    inside = (F.col("left") > F.col("a")) & (F.col("right") + 1 < F.col("b"))
    heights = stats.filter(F.col("n") > 5).select(*WINDOW_KEYS, "max_attack")
    candidates = (tops.join(pieces.select(*WINDOW_KEYS, CHUNK, "a", "b"), [*SERIES, CHUNK]).filter(inside)
                  .join(heights, WINDOW_KEYS)
                  .filter(F.col("value") >= F.col("max_attack") * F.lit(0.80))
                  .select(*WINDOW_KEYS, "idx", "value"))
    spaced = suppress_by_distance(candidates, cfg.rebound_distance, group="window_id", **how)
    counted = spaced.groupBy(*WINDOW_KEYS).agg(F.count(F.lit(1)).alias("_peaks"))
    share = F.least(F.lit(3).cast("long"), F.coalesce("_peaks", F.lit(0).cast("long"))) / F.lit(3.0)
    return stats.join(counted, WINDOW_KEYS, "left").withColumn("rebound", share).drop("_peaks")


def choose_camera(windows: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per window: the louder camera, how clear the choice is, and that camera's numbers.

    A camera without samples in the window counts as 0.
    """
    numbers = [c for c in stats.columns if c not in WINDOW_KEYS]

    def of(cam: int, c: str):
        return F.max(F.when(F.col("cam") == cam, F.col(c))).alias(f"_{c}{cam}")

    sides = stats.groupBy("game_id", "window_id").agg(*[of(cam, c) for c in numbers for cam in (1, 2)])
    m1, m2 = (F.coalesce(F.col(f"_max_attack{cam}"), F.lit(0.0)) for cam in (1, 2))
    out = (windows.join(sides, ["game_id", "window_id"], "left")
           .withColumn("m1", m1).withColumn("m2", m2)
           .withColumn("primary_cam", F.when(F.col("m1") >= F.col("m2"), F.lit(1)).otherwise(F.lit(2)))
           .withColumn("conf", F.abs(F.col("m1") - F.col("m2")) / (F.col("m1") + F.col("m2") + F.lit(EPS))))
    for c in numbers:
        picked = F.when(F.col("primary_cam") == 1, F.col(f"_{c}1")).otherwise(F.col(f"_{c}2"))
        fallback = F.lit(1.0) if c == "p99" else F.lit(0)
        out = out.withColumn(c, F.coalesce(picked, fallback))
    return out.drop(*[f"_{c}{cam}" for c in numbers for cam in (1, 2)])


def score_windows(chosen: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Weighted sum of scaled maximum, rebound and scaled drop, reduced when the cameras agree too well."""
    scale = F.col("p99") + F.lit(EPS)
    attack = F.greatest(F.lit(0.0), F.col("max_attack") / scale)
    drop = F.greatest(F.lit(0.0), F.col("drop") / scale)
    base = F.lit(cfg.w_attack) * attack + F.lit(cfg.w_rebound) * F.col("rebound") + F.lit(cfg.w_drop) * drop
    weighted = base * (F.lit(0.85) + F.lit(0.15) * F.col("conf"))
    return chosen.withColumn("score", F.when(F.col("conf") < 0.15, weighted * F.lit(0.85)).otherwise(weighted))


def rank_events(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Events by score, best first; `top` keeps the best of each game.

    The top-k takes the best of each hour-sized bucket first, so no game is ordered as a whole.
    """
    if top is None:
        return scored.orderBy(F.col("score").desc(), "game_id", "start_s")
    best = [F.col("score").desc(), F.col("start_s")]
    hour = F.floor(F.col("start_s") / F.lit(3600.0))
    local = F.row_number().over(Window.partitionBy("game_id", "_hour").orderBy(*best))
    short = scored.withColumn("_hour", hour).withColumn("_rank", local).filter(F.col("_rank") <= top).drop("_hour", "_rank")
    overall = F.row_number().over(Window.partitionBy("game_id").orderBy(*best))
    return short.withColumn("rank", overall.cast("long")).filter(F.col("rank") <= top)

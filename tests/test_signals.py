import numpy as np
import pytest
from pyspark.sql import functions as F

from peakline import DetectConfig
from peakline.operators import signals as SG
from tests import plain

RNG = np.random.default_rng(3)


def frame(spark, series, audio=True):
    rows = [(g, 1, i, float(v), float(v) / 2, float(v % 3) if audio else None) for g, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "game_id int, cam int, idx long, net double, slot double, audio double")


def column(df, name, game):
    return [r[name] for r in df.filter(F.col("game_id") == game).orderBy("idx").collect()]


@pytest.mark.parametrize("win", [1, 2, 5, 6])
@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_moving_average(spark, win, chunk):
    x = RNG.random(41) * 10
    got = column(SG.moving_average(frame(spark, {0: x}), win, col="net", chunk=chunk), "smooth", 0)
    assert got == pytest.approx(plain.smooth(x, win), abs=2e-9)
    if win > 1:
        assert got == pytest.approx(np.convolve(x, np.ones(win) / win, mode="same"), abs=2e-9)


def test_thresholds(spark):
    x = {0: RNG.random(105), 1: RNG.random(9)}
    df = frame(spark, x).withColumn("smooth", F.col("net"))
    rolling, whole = SG.rolling_threshold(df, 2, 90, segment_s=10), SG.global_threshold(df, 90, chunk=10)
    for g in x:
        assert column(rolling, "threshold", g) == pytest.approx(plain.thresholds(x[g], 20, 90, 70))
        assert column(whole, "threshold", g) == pytest.approx([np.percentile(x[g], 90)] * len(x[g]))


def test_fusion_needs_audio_for_every_sample(spark):
    x = {0: RNG.random(50) * 9, 1: RNG.random(50) * 9}
    df = frame(spark, x).withColumn("audio", F.when(~((F.col("game_id") == 1) & (F.col("idx") == 4)), F.col("audio")))
    fused = SG.fuse_signals(df, chunk=16)
    for g in x:
        flow = 0.7 * x[g] + 0.3 * x[g] / 2
        want = 0.8 * flow / (np.percentile(flow, 99) + 1e-6)
        if g == 0:
            want = want + 0.2 * (x[g] % 3) / (np.percentile(x[g] % 3, 99) + 1e-6)
        assert column(fused, "raw", g) == pytest.approx(want)
    silent = SG.fuse_signals(frame(spark, x, audio=False), audio_weight=0.0)
    assert column(silent, "raw", 0) == pytest.approx(0.8 * SG_flow(x[0]))


def SG_flow(x):
    flow = 0.85 * x
    return flow / (np.percentile(flow, 99) + 1e-6)


def test_scaling_a_silent_series(spark):
    got = column(SG.normalize_p99(frame(spark, {0: np.zeros(30)}), "net"), "net_norm", 0)
    assert got == [0.0] * 30


@pytest.mark.parametrize("segment_s", [0.5, 3.0, 300.0])
def test_profile_looks_past_chunk_edges(spark, segment_s):
    """Halo larger than a chunk, and plateaus over several chunks. Only the second detector has a level per segment."""
    cfg = DetectConfig.live(fps=6, segment_s=segment_s, thresh_pct=80)
    x = np.repeat(RNG.integers(0, 5, 40), RNG.integers(1, 9, 40)).astype(float)
    profile = SG.attack_profile(frame(spark, {0: x}), cfg, fused=False)
    s = plain.smooth(0.7 * x + 0.3 * x / 2, cfg.smooth_win)
    assert column(profile, "smooth", 0) == pytest.approx(s, abs=2e-9)
    assert column(profile, "fwd_min", 0) == pytest.approx([s[i:i + cfg.drop_samples].min() for i in range(len(s))], abs=2e-9)
    seg = cfg.segment_samples
    assert set(column(profile, "segment_level", 0)) == {None}
    cfg = cfg.replace(audio_weight=0.0)
    fused = SG.attack_profile(frame(spark, {0: x}), cfg, fused=True)
    s = plain.smooth(cfg.flow_weight * (0.7 * x + 0.3 * x / 2) / (np.percentile(0.7 * x + 0.3 * x / 2, 99) + 1e-6), cfg.smooth_win)
    assert column(fused, "smooth", 0) == pytest.approx(s, abs=2e-9)
    assert column(fused, "segment_level", 0) == pytest.approx([np.percentile(s[i // seg * seg:i // seg * seg + seg], 80) for i in range(len(s))], abs=1e-8)


def test_p99_of_a_missing_camera(spark):
    known = spark.createDataFrame([(0, 1), (0, 2)], "game_id int, cam int")
    df = frame(spark, {0: np.arange(101.0)}).withColumn("smooth", F.col("net"))
    assert {r.cam: r.p99 for r in SG.series_p99(df, cameras=known).collect()} == {1: 99.0, 2: 1.0}

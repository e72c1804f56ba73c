import numpy as np
import pytest
from pyspark.sql import functions as F

from peakline import DetectConfig
from peakline.operators import limits
from peakline.plans import detect as D
from tests import plain


def games(seed):
    """Ragged recordings: two cameras, one camera, a short one, a silent one, long flat tops, no audio."""
    rng = np.random.default_rng(seed)

    def noisy(n):
        return np.abs(np.cumsum(rng.normal(size=n))) * 3 + rng.random(n), rng.random(n) * 5, rng.random(n) * 7

    def flat(n):
        v = np.repeat(rng.integers(0, 6, n), rng.integers(1, 60, n))[:n].astype(float)
        return v, v, v

    net, slot, _ = noisy(700)
    return {0: {1: noisy(2000), 2: noisy(1900)}, 1: {2: noisy(800)}, 2: {1: noisy(9), 2: noisy(300)},
            3: {1: tuple(np.zeros(200) for _ in range(3)), 2: noisy(200)}, 4: {1: flat(1500), 2: flat(1500)}, 5: {1: (net, slot, None), 2: noisy(700)}}


CONFIGS = {
    "live": DetectConfig.live(fps=4), "default": DetectConfig(fps=12, thresh_pct=80.0, min_sep_s=2.0),
    "short_segments": DetectConfig.live(fps=12, segment_s=5.0, thresh_pct=75.0, min_sep_s=1.0, cooldown_s=20.0, audio_weight=0.3),
    "wide": DetectConfig(fps=8, merge_gap_s=10.0, segment_s=20.0, thresh_pct=60.0, min_sep_s=0.5, big_color_min="Yellow"),
}


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("name", CONFIGS)
def test_detection_equals_plain_code(spark, name, version):
    cfg, data = CONFIGS[name], games(list(CONFIGS).index(name))
    rows = [(g, cam, i, float(net[i]), float(slot[i]), None if audio is None else float(audio[i]))
            for g, cams in data.items() for cam, (net, slot, audio) in cams.items() for i in range(len(net))]
    df = spark.createDataFrame(rows, "game_id int, cam int, idx long, net double, slot double, audio double").repartition(3)
    got = (D.detect_v1 if version == 1 else D.detect_v2)(df, cfg).collect()
    for g, cams in data.items():
        want = plain.detect(cams, cfg, version)
        mine = sorted((r.start_s, r.end_s, r.score, r.primary_cam, r.conf) for r in got if r.game_id == g)
        assert len(mine) == len(want), g
        for a, b in zip(mine, want):
            assert a == pytest.approx(b, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("version", [1, 2])
def test_large_plans_give_the_same(spark, version, monkeypatch):
    """Every counted bound set to nothing: the plans for large data on small data."""
    for name in ("SHORT_SERIES", "SMALL_GROUP", "FEW_BUCKETS", "FEW_SERIES"):
        monkeypatch.setattr(limits, name, 0)
    test_detection_equals_plain_code(spark, "short_segments", version)


def test_no_signals(spark):
    df = spark.createDataFrame([], "game_id int, cam int, idx long, net double, slot double, audio double")
    assert D.detect_v2(df, DetectConfig.live()).count() == 0


def test_batch_of_quiet_games(spark, tmp_path):
    """Games without events get headers; a batch of only such games, and an empty one, end well."""
    from peakline.plans.batch import run_game_batch

    cfg = DetectConfig.live(fps=4)
    quiet = spark.range(200).select((F.col("id") % 2).cast("int").alias("game_id"), F.lit(1).alias("cam"), F.floor(F.col("id") / 2).alias("idx"), *[F.lit(0.0).alias(c) for c in ("net", "slot", "audio")])
    paths = run_game_batch(spark, quiet, str(tmp_path / "quiet"), cfg)
    assert sorted(map(tuple, spark.read.text(paths["events"]).collect())) == [("start_s,end_s,score,primary_cam,confidence", g) for g in (0, 1)]
    assert {r[1] for r in spark.read.text(paths["markers"]).collect()} == {r[1] for r in spark.read.text(paths["edl"]).collect()} == {0, 1}
    run_game_batch(spark, quiet.limit(0), str(tmp_path / "none"), cfg)


def recording(spark):
    """Three games of noise, two cameras each."""
    rng = np.random.default_rng(7)
    rows = [(g, cam, i, float(v), float(v), float(v)) for g in range(3) for cam in (1, 2) for i, v in enumerate(np.abs(rng.normal(size=700)))]
    return spark.createDataFrame(rows, "game_id int, cam int, idx long, net double, slot double, audio double")


def test_tables_are_computed_when_asked_for(spark, monkeypatch):
    """The peaks need no window, the windows before the cooldown no cooldown."""
    cfg = DetectConfig.live(fps=4)
    run = D.run_detection(recording(spark), cfg, 2)
    with monkeypatch.context() as patch:
        patch.setattr(D.WN, "merge_intervals", None)
        assert D.debug_series(D.sample_levels(run.attack), run.peaks, cfg).filter("is_peak").count() == run.peaks.count() > 0
    with monkeypatch.context() as patch:
        patch.setattr(D.WN, "cooldown", None)
        assert run.before_cooldown.count() == run.judged.count() > 0


def test_levels_of_the_profile_are_the_rolling_threshold(spark):
    from peakline.operators.signals import rolling_threshold

    cfg = DetectConfig.live(fps=4, segment_s=30.0)
    attack = D.run_detection(recording(spark), cfg, 2).attack
    want = rolling_threshold(attack.samples.select("game_id", "cam", "idx", "smooth"), cfg.fps, cfg.thresh_pct, segment_s=30.0)
    row = lambda df: sorted(map(tuple, df.select("game_id", "cam", "idx", "smooth", "threshold").collect()))
    assert row(D.sample_levels(attack)) == row(want)


def test_scores_use_the_detections_own_rebounds(spark, monkeypatch):
    """score_windows looks for rebounds once, not once for the detection and once more."""
    from peakline.catalog import queries as Q

    calls, rebound = [], D.S.window_rebound
    monkeypatch.setattr(Q, "_tables", {})
    monkeypatch.setattr(D.S, "window_rebound", lambda *a, **k: calls.append(1) or rebound(*a, **k))
    assert Q.QUERIES["score_windows"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1

import numpy as np
import pytest

from peakline import DetectConfig
from peakline.operators import limits
from peakline.operators import windows as WN
from tests import plain


@pytest.mark.parametrize("small", [10 ** 6, 0])
@pytest.mark.parametrize("gap", [0.0, 2.0, 500.0])
def test_merge_intervals(spark, small, gap, monkeypatch):
    monkeypatch.setattr(limits, "SMALL_GROUP", small)
    monkeypatch.setattr(limits, "FEW_BUCKETS", small)
    rng = np.random.default_rng(11)
    games = {0: [(float(s), float(s + d)) for s, d in zip(rng.integers(-7, 40000, 200), rng.integers(0, 60, 200))],
             1: [(0.0, 30000.0), (100.0, 110.0), (20000.0, 20013.0), (30002.0, 30003.0)], 2: [(5.0, 6.0)],
             3: [(0.0, 1.0), (3.0, 4.0), (3.0, 9.0), (9.0, 9.5)]}
    df = spark.createDataFrame([(g, s, e) for g, iv in games.items() for s, e in iv], "game_id int, start_s double, end_s double")
    got = WN.merge_intervals(df, gap).collect()
    for g, iv in games.items():
        rows = sorted((r.window_id, r.start_s, r.end_s) for r in got if r.game_id == g)
        assert [r[1:] for r in rows] == plain.merge(iv, gap)
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))


def test_sanitize(spark):
    df = spark.createDataFrame([(-7.0, -3.0), (-1.0, 6.0), (4.0, 4.1)], "start_s double, end_s double")
    assert [tuple(r) for r in WN.sanitize_windows(df).collect()] == [(0.0, 0.5), (0.0, 6.0), (4.0, 4.5)]


def test_cap_and_colors(spark):
    cfg = DetectConfig.live()
    rows = [(1.0, 0.0, 20.0), (1.0, 0.0, 20.5), (1.3, 0.0, 40.0), (1.31, 0.0, 40.0), (1.6, 5.0, 90.0), (1.7, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "score double, start_s double, end_s double")
    got = [(r.color, r.end_s) for r in WN.cap_duration(WN.with_color(df), cfg).collect()]
    assert got == [("Blue", 20.0), ("Blue", 20.0), ("Yellow", 20.0), ("Orange", 32.0), ("Orange", 37.0), ("Red", 10.0)]


def test_no_cooldown_is_identity(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.5, 2.0)], "game_id int, start_s double, score double")
    assert WN.cooldown(df, 0.0) is df


def test_weights_warn():
    with pytest.warns(UserWarning):
        DetectConfig(w_attack=0.9)
    with pytest.raises(ValueError):
        DetectConfig(big_color_min="Blue")

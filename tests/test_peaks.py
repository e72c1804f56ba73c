import numpy as np
import pytest

from peakline.operators.peaks import local_maxima, peaks_above, suppress, suppress_by_distance
from tests import plain


def frame(spark, series):
    rows = [(g, 1, i, float(v)) for g, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "game_id int, cam int, idx long, smooth double")


EDGES = [[], [1, 2], [1, 2, 1], [2, 2, 1], [1, 2, 2], [0, 3, 3, 0], [0, 3, 3, 3, 0], [1] * 40, [0] + [5] * 37 + [0], [0] + [5] * 37, [5] * 37 + [0],
         [0] * 20 + [4] * 20 + [5, 0], list(range(30)), [0, 1, 0, 1, 0, 1, 0]]


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_local_maxima(spark, chunk):
    rng = np.random.default_rng(chunk)
    series = dict(enumerate(EDGES + [rng.integers(0, k, 300).tolist() for k in (2, 3, 10)]))
    got = local_maxima(frame(spark, series), chunk=chunk).collect()
    for g, x in series.items():
        assert sorted((r.idx, r.left, r.right) for r in got if r.game_id == g) == plain.maxima(x), (g, x)


def test_height_is_inclusive(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "value double, level double")
    assert peaks_above(df, "level").count() == 2 and peaks_above(df, 2.5).count() == 1


@pytest.mark.parametrize("how", [dict(), dict(span=4, reach=2, widest=4), dict(span=2, reach=1, widest=64)])
@pytest.mark.parametrize("values", ["noise", "ties", "ramp", "equal"])
def test_suppression(spark, how, values):
    """Ramps and equal heights are single chains of rivals: many rounds, same result."""
    rng = np.random.default_rng(7)
    at = np.unique(rng.integers(0, 900, 240))
    v = {"noise": rng.random(len(at)), "ties": rng.integers(0, 3, len(at)), "ramp": np.arange(len(at)), "equal": np.ones(len(at))}[values]
    rows = [(g, 1, int(i), float(x)) for g in (0, 1) for i, x in zip(at, v)]
    df = spark.createDataFrame(rows, "game_id int, cam int, idx long, value double")
    got = {(r.game_id, r.idx) for r in suppress_by_distance(df, 9, **how).collect()}
    height = dict(zip(at.tolist(), v))
    want = plain.greedy(height, 9, lambda i: (-height[i], -i), lambda i: i)
    assert got == {(g, i) for g in (0, 1) for i in want}
    for g in (0, 1):
        gaps = np.diff(sorted(i for k, i in got if k == g))
        assert gaps.min() >= 9


def test_suppression_keeps_groups_apart(spark):
    rows = [(0, 1, w, i, float(i % 5)) for w in (1, 2, 3) for i in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "game_id int, cam int, window_id long, idx long, value double")
    got = {(r.window_id, r.idx) for r in suppress_by_distance(df, 5, group="window_id", span=3, reach=2).collect()}
    want = plain.greedy(range(0, 40, 2), 5, lambda i: (-(i % 5), -i), lambda i: i)
    assert got == {(w, i) for w in (1, 2, 3) for i in want}


def test_suppression_on_seconds_prefers_the_earlier(spark):
    rows = [(0, 0.0, 1.0), (0, 11.999, 1.0), (0, 12.0, 1.0), (0, 24.0, 0.5), (0, 30.0, 2.0), (1, 0.1, 1.0), (1, 0.30000000000000004, 1.0)]
    df = spark.createDataFrame(rows, "game_id int, start_s double, score double")
    got = sorted((r.game_id, r.start_s) for r in suppress(df, ["game_id"], "start_s", [("score", True), ("start_s", False)], 12.0).collect())
    assert got == [(0, 0.0), (0, 12.0), (0, 30.0), (1, 0.1)]

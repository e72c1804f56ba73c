import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakline.operators import extract as EX
from peakline.sources import rois as R

RNG = np.random.default_rng(9)
W, H, N = 6, 4, 11
ROIS = [(0, 1, "net", 1, 1, 2, 2), (0, 1, "slot", 4, 3, 9, 9), (0, 2, "net", -3, 0, 99, 1), (0, 2, "slot", 50, 50, 0, -1)]


def pictures():
    return {(0, cam): RNG.integers(0, 256, (N, H, W)).astype(np.uint8) for cam in (1, 2)}


def clamp(x, y, w, h):
    x, y = max(0, min(x, W - 1)), max(0, min(y, H - 1))
    return x, y, max(1, min(w, W - x)), max(1, min(h, H - y))


@pytest.mark.parametrize("binary", [False, True])
@pytest.mark.parametrize("run", [1, 3, 64])
def test_frame_differences(spark, binary, run):
    pics = pictures()
    rows = [(g, c, i, W, H, bytearray(p[i].tobytes()) if binary else [int(v) for v in p[i].ravel()]) for (g, c), p in pics.items() for i in range(N)]
    kind = "binary" if binary else "array<smallint>"
    frames = spark.createDataFrame(rows, f"game_id int, cam int, frame_idx long, width int, height int, pixels {kind}")
    rois = spark.createDataFrame(ROIS, "game_id int, cam int, roi string, x int, y int, w int, h int")
    got = {(r.cam, r.idx): (r.net, r.slot, r.full) for r in EX.framediff_energy(frames, rois, run).collect()}
    assert len(got) == 2 * (N - 1)
    for (_, cam), p in pics.items():
        for i in range(1, N):
            d = np.abs(p[i].astype(int) - p[i - 1].astype(int))
            want = []
            for roi in ("net", "slot"):
                x, y, w, h = clamp(*next(r[3:] for r in ROIS if r[1] == cam and r[2] == roi))
                want.append(d[y:y + h, x:x + w].sum())
            assert got[cam, i - 1] == (*want, d.sum())


def test_roi_mean(spark):
    p = RNG.random((3, H, W)).astype(np.float32)
    motion = spark.createDataFrame([(0, 1, i, W, H, [float(v) for v in p[i].ravel()]) for i in range(3)],
                                   "game_id int, cam int, frame_idx long, width int, height int, mag array<float>")
    rois = spark.createDataFrame(ROIS, "game_id int, cam int, roi string, x int, y int, w int, h int")
    for r in EX.roi_mean_motion(motion, rois).collect():
        assert r.net == pytest.approx(p[r.idx, 1:3, 1:3].mean(), rel=1e-6) and r.slot == pytest.approx(p[r.idx, 3:4, 4:6].mean(), rel=1e-6)


@pytest.mark.parametrize("n", [3, 10, 11, 39, 40])
def test_audio_to_grid(spark, n):
    """Partial windows, and a picture longer than its sound."""
    x = RNG.integers(-30000, 30000, n)
    audio = spark.createDataFrame([(0, 1, i, int(v)) for i, v in enumerate(x)], "game_id int, cam int, sample_idx long, amp int")
    points = EX.audio_rms(audio, rate=20)
    ws = 10
    want = [np.sqrt(np.mean(x[k * ws:(k + 1) * ws].astype(float) ** 2)) for k in range(max(1, n // ws))]
    assert [r.rms for r in points.orderBy("k").collect()] == pytest.approx(want)
    grid = EX.series_grid(spark.createDataFrame([(0, 1, 40)], "game_id int, cam int, n long"))
    got = [r.rms for r in EX.interp_to_grid(points, grid, fps=12).orderBy("idx").collect()]
    assert got == pytest.approx(np.interp(np.arange(40) / 12, (np.arange(len(want)) + 0.5) * 0.5, want))
    signals = grid.withColumn("net", F.lit(1.0)).unionByName(grid.withColumn("cam", F.lit(2)).withColumn("net", F.lit(1.0)))
    filled = EX.audio_or_zeros(signals, EX.interp_to_grid(points, grid, fps=12))
    assert filled.count() == 80 and filled.filter("cam = 2").agg(F.sum("audio")).first()[0] == 0.0


def test_grid(spark):
    rows = [(0, 1, 0.0, 1.0), (0, 1, 0.24, 2.0), (0, 1, 1.3, 4.0), (1, 1, 0.6, 5.0)]
    df = spark.createDataFrame(rows, "game_id int, cam int, t_s double, value double")
    got = [tuple(r) for r in EX.sample_to_grid(df, 4).orderBy("game_id", "idx").collect()]
    assert got == [(0, 1, 0, 3.0), (0, 1, 1, 0.0), (0, 1, 2, 0.0), (0, 1, 3, 0.0), (0, 1, 4, 0.0), (0, 1, 5, 4.0), (1, 1, 0, 0.0), (1, 1, 1, 0.0), (1, 1, 2, 5.0)]
    early = df.unionByName(df.limit(1).withColumn("t_s", F.lit(-1.0)))
    with pytest.raises(Exception, match="before the origin"):
        EX.sample_to_grid(early, 4).collect()
    assert EX.sample_to_grid(early, 4, origin_s=-1.0).agg(F.max("idx")).first()[0] == 9


def test_read_rois(spark, tmp_path):
    good = {"camera_1": {"net": [1, 2, 3.9, 4], "slot": [1, 2, 3, 4]}, "camera_2": {"net": [-1, 2, 3, 4], "slot": [0, 0, 0, 0]}}
    folder = tmp_path / "game_id=g1"
    folder.mkdir()
    (folder / "rois.json").write_text(json.dumps(good, indent=2))
    rows = R.read_rois(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and {(r.cam, r.roi): (r.x, r.y, r.w, r.h) for r in rows}[1, "net"] == (1, 2, 3, 4) and rows[0].game_id == "g1"
    good["camera_2"]["slot"] = [1, 2, 3]
    (folder / "rois.json").write_text(json.dumps(good))
    with pytest.raises(Exception, match="rectangle needs 4 numbers"):
        R.read_rois(spark, str(tmp_path)).collect()
    del good["camera_2"]["slot"]
    (folder / "rois.json").write_text(json.dumps(good))
    partial = R.read_rois(spark, str(tmp_path), strict=False)
    assert partial.count() == 3 and R.complete_rois(partial).isEmpty()
    with pytest.raises(Exception, match="rectangle needs 4 numbers"):
        R.read_rois(spark, str(tmp_path)).collect()


def test_rects_and_paths(spark):
    df = spark.createDataFrame([(1, 50, 40, 10, -9), (2, 10, 10, 13, 50), (3, 5000, 5000, 0, 0)], "k int, x1 int, y1 int, x2 int, y2 int")
    assert [tuple(r) for r in R.rects_from_corners(df, 100, 60).collect()] == [(1, 10, 0, 40, 40), (3, 0, 0, 99, 59)]
    paths = ["/a/x_cam1.mp4", "/a/b_cam1_z.mp4", "/a/cam2.mp4", "/a/.cam2.mp4", "/b/cam1.mp4", "/b/cam2.mov", "/c/cam1cam2.mp4", "/c/d/cam2.mp4"]
    got = sorted(map(tuple, R.pair_sources(spark.createDataFrame([(p,) for p in paths], "path string")).collect()))
    assert got == [("/a", "/a/b_cam1_z.mp4", "/a/cam2.mp4"), ("/c", "/c/cam1cam2.mp4", "/c/cam1cam2.mp4")]


def test_scaled_rois(spark):
    df = spark.createDataFrame([(0, 1, "net", 10, 20, 31, 40)], "game_id int, cam int, roi string, x int, y int, w int, h int")
    assert tuple(EX.scale_rois(df, 0.5).first())[3:] == (5, 10, 15, 20) and EX.scale_rois(df) is df


@pytest.mark.parametrize("bucket_s", [0.5, 7.0, 1000.0])
def test_interpolation_between_irregular_points(spark, bucket_s):
    """Gaps over many buckets, points before the first and behind the last sample, at samples' own times and twice at one time."""
    t = np.unique(np.concatenate([RNG.random(30) * 20 - 2, [3.0, 3.25, 55.0, 200.0]]))
    v = RNG.random(len(t))
    rows = [(0, 1, float(a), float(b)) for a, b in zip(t, v)] + [(0, 1, 3.0, -1.0), (0, 1, None, 9.0), (0, 1, 4.0, None), (0, 1, float("nan"), 9.0), (0, 2, 500.0, 4.0)]
    points = spark.createDataFrame(rows, "game_id int, cam int, t double, rms double")
    grid = EX.series_grid(spark.createDataFrame([(0, 1, 400), (0, 2, 3), (1, 1, 2)], "game_id int, cam int, n long"))
    got = {(r.game_id, r.cam, r.idx): r.rms for r in EX.interp_to_grid(points, grid, fps=4, bucket_s=bucket_s).collect()}
    assert len(got) == 405
    assert [got[0, 1, i] for i in range(400)] == pytest.approx(np.interp(np.arange(400) / 4, t, v))
    assert [got[0, 2, i] for i in range(3)] == [4.0] * 3 and got[1, 1, 0] is None and got[1, 1, 1] is None
    assert EX.interp_to_grid(points, grid.limit(0), fps=4).isEmpty()


@pytest.mark.parametrize("chunk", [1, 3, 3600])
@pytest.mark.parametrize("n_samples", [None, 9000, 40])
def test_grid_with_long_gaps(spark, chunk, n_samples):
    """Gaps inside a chunk, over chunk edges and longer than a block; a series whose rows are all cut off."""
    at = {(0, 1): [0, 1, 1, 7, 38, 8500], (0, 2): [5], (1, 1): [8000, 8001]}
    rows = [(g, c, float(i), i + 1) for (g, c), idx in at.items() for i in idx]
    df = spark.createDataFrame(rows, "game_id int, cam int, t_s double, value long")
    got = {}
    for r in EX.sample_to_grid(df, 1, n_samples=n_samples, chunk=chunk).collect():
        assert got.setdefault((r.game_id, r.cam), {}).setdefault(r.idx, r.value) is r.value
    for key, idx in at.items():
        n = n_samples or max(idx) + 1
        assert sorted(got[key]) == list(range(n))
        assert {i: v for i, v in got[key].items() if v} == {i: idx.count(i) * (i + 1) for i in set(idx) if i < n}


def test_grid_shuffles_cells_and_runs_only(spark):
    rows = [(0, 1, float(i), 1.0) for i in (3, 100_000, 2_000_000)]
    df = spark.createDataFrame(rows, "game_id int, cam int, t_s double, value double").withColumn("idx", F.col("t_s").cast("long"))
    cells = EX.occupied_cells(df, ["game_id", "cam"], ["value"], 3600)
    lengths = cells.groupBy("game_id", "cam").agg((F.max("idx") + 1).alias("_n"))
    assert cells.count() == 3 and EX.empty_runs(cells, lengths, ["game_id", "cam"]).count() <= 2_000_000 / 4096 + 4
    assert EX.sample_to_grid(df, 1).count() == 2_000_001


def test_frame_differences_of_mixed_shapes():
    """Sizes and rectangles change from frame to frame; lanes of sums are filled to the brim."""
    import pandas as pd

    from peakline.operators.kernels import frame_diff_energy

    shapes = [(300, 200), (8, 8), (300, 200), (1, 1), (64, 129), (8, 8), (1029, 1100), (1029, 1100)]
    a = [np.full(w * h, 255, np.uint8) if i % 3 == 0 else RNG.integers(0, 256, w * h).astype(np.uint8) for i, (w, h) in enumerate(shapes)]
    b = [np.zeros(w * h, np.uint8) if i % 3 == 0 else RNG.integers(0, 256, w * h).astype(np.uint8) for i, (w, h) in enumerate(shapes)]
    rects = [[(int(RNG.integers(0, w)), int(RNG.integers(0, h))) for w, h in shapes] for _ in range(2)]
    frames = [pd.DataFrame([(x, y, w - x, h - y) for (x, y), (w, h) in zip(r, shapes)], columns=list("xywh")) for r in rects]
    got = frame_diff_energy(pd.Series([x.tobytes() for x in a]), pd.Series([x.tobytes() for x in b]), pd.Series([w for w, _ in shapes]), pd.Series([h for _, h in shapes]), *frames)
    for i, (w, h) in enumerate(shapes):
        d = np.abs(a[i].astype(int) - b[i].astype(int)).reshape(h, w)
        assert got.iloc[i].tolist() == [d[f.y[i]:, f.x[i]:].sum() for f in frames] + [d.sum()]
    assert frame_diff_energy(*[pd.Series([], dtype=object)] * 2, *[pd.Series([], dtype=int)] * 2, *[f.iloc[:0] for f in frames]).empty

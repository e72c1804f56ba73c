"""Plans that must hold at any scale: no pairing of all rows, no window or exchange over a single partition."""

import pytest

from peakline import DetectConfig
from peakline.catalog import fixtures as X
from peakline.operators import extract as EX
from peakline.operators import limits
from peakline.operators import markers as M
from peakline.operators import signals as SG
from peakline.operators import timeline as TL
from peakline.operators import windows as WN
from peakline.operators.chunks import number_rows
from peakline.operators.peaks import local_maxima
from peakline.operators.scoring import window_pieces, window_samples

SF = "/root/testdata/sf0.001"
CFG = DetectConfig.live(fps=4)
LARGE = ("SHORT_SERIES", "SMALL_GROUP", "FEW_BUCKETS", "FEW_SERIES")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def build(spark):
    signals = X.signals(spark, SF).withColumnRenamed("net", "smooth")
    markers = X.markers(spark, SF)
    ranges = TL.expand_markers(markers, 60)
    windows = spark.createDataFrame([(0, 1, 0.0, 13.0)], "game_id int, window_id long, start_s double, end_s double")
    audio, frames = X.audio(spark, SF), X.frames(spark, SF)
    points = EX.audio_rms(audio, X.RATE)
    lengths = points.groupBy("game_id", "cam").count().withColumnRenamed("count", "n")
    return {
        "sample_to_grid": EX.sample_to_grid(X.timed_events(spark, SF), 1 / 600, values=["net", "slot", "audio"]),
        "profile": SG.attack_profile(X.signals(spark, SF), CFG, fused=True),
        "rolling_threshold": SG.rolling_threshold(signals, 4, 95),
        "local_maxima": local_maxima(signals, chunk=100),
        "window_samples": window_samples(window_pieces(windows, CFG), signals, CFG),
        "merge_intervals": WN.merge_intervals(windows, 0.0),
        "numbering": M.number_by_frame(markers, "frame", "no"),
        "one_level": number_rows(markers, ["game_id"], [("_b", markers.frame)], ["seq"], "no"),
        "fcpxml": M.fcpxml_lines(markers, 60), "edl": M.edl_lines(M.to_edl_events(X.markers_raw(spark, SF), 60), 60),
        "split_clips": TL.split_clips(X.clips(markers), TL.split_points(ranges)),
        "assign_angles": TL.assign_angles(X.clips(markers), ranges),
        "merge_markers": TL.merge_markers(*X.merge_sides(markers)),
        "framediff": EX.framediff_energy(frames, X.frame_rois(frames)),
        "interp": EX.interp_to_grid(points, EX.series_grid(lengths), 12),
    }


@pytest.fixture(scope="module", params=[(), LARGE], ids=["small", "large"])
def plans(spark, request):
    with pytest.MonkeyPatch.context() as patch:
        for name in request.param:
            patch.setattr(limits, name, 0)
        return {name: plan(df) for name, df in build(spark).items()}


@pytest.mark.parametrize("bad", ["CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition"])
def test_no_single_task_and_no_pairing(plans, bad):
    assert [name for name, text in plans.items() if bad in text] == []


def test_scan_reads_only_what_it_needs(plans):
    scan = plans["sample_to_grid"]
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in scan
    assert "props" not in scan


def test_frames_are_shuffled_once(plans):
    """Pixels go through one exchange; the chunk list and the rectangles travel without them."""
    assert sum("pixels" in line and "Exchange" in line for line in plans["framediff"].splitlines()) <= 1


def test_profile_sorts_the_samples_once_per_window_key(plans):
    assert plans["profile"].count("Window [") <= 5


def test_kept_tables_are_read_by_column(spark):
    """What several steps read is stored once; a step reads the columns it names."""
    from peakline.operators.cut import cut

    kept = cut(spark.range(10).selectExpr("id", "id * 2 AS twice", "cast(null AS double) AS none"))
    assert "ReadSchema: struct<twice:bigint>" in plan(kept.select("twice"))
    assert sorted(map(tuple, kept.collect())) == [(i, 2 * i, None) for i in range(10)]
    assert cut(kept.filter("id < 0")).count() == 0


def test_profile_has_one_window_for_what_follows_the_smoothing(spark):
    assert plan(SG.attack_profile(X.signals(spark, SF), CFG, fused=True)).count("Window [") <= 3


def test_turns_are_counted_by_hash(spark):
    from peakline.operators.peaks import tops_of

    marked = SG.attack_profile(X.signals(spark, SF), CFG, fused=True)
    assert "SortAggregate" not in plan(tops_of(marked, 1, "smooth", chunks=4))


def test_small_files_of_many_games_are_written_by_many_tasks(spark, tmp_path):
    from peakline.sources.tables import write_markers

    rows = spark.range(400).selectExpr("cast(id % 40 AS int) AS game_id", "id AS seq", "id AS frame", "'n' AS name", "'' AS note", "'Red' AS color", "1L AS duration")
    write_markers(rows, str(tmp_path / "out"))
    assert len({f.name.split("-")[1] for f in tmp_path.glob("out/game_id=*/part-*")}) > 1

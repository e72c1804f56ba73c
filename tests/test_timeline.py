import random

import pytest
from pyspark.sql import functions as F

from peakline.operators import limits
from peakline.operators import timeline as TL
from peakline.plans.detect import conform_timeline

MARKER = "game_id int, seq long, frame long, name string, note string, color string, duration long"


def test_expand(spark):
    rows = [(0, 1, 10, "PLAY cam2", "win=2.5s", "Red", 1), (0, 2, 20, " replay ", "win=2s", "Red", 1), (0, 3, 30, "PLAY", "none", "Red", 1),
            (0, 4, 40, "PLAY", "win=0.0s", "Red", 1), (0, 5, 50, None, "[yellow] cam3 win=0.001s", None, None), (0, 6, 60, "x", None, "Red", 1)]
    df = spark.createDataFrame(rows, MARKER)
    got = [(r.seq, r.start_frame, r.end_frame, r.angle, r.color, r.duration) for r in TL.expand_markers(df, 60, 100).orderBy("seq").collect()]
    assert got == [(1, 110, 260, 1, "Blue", 150), (5, 150, 151, 2, "Yellow", 1)]
    assert tuple(TL.expansion_counts(df).first()) == (0, 2, 4)


def brute_pieces(clips, points):
    out = []
    for g, c, s, e, a in clips:
        edges = [s] + sorted(p for k, p in points if k == g and s < p < e) + [e]
        out += [(g, c, x, y, a) for x, y in zip(edges, edges[1:])]
    return sorted(out)


def brute_angles(pieces, ranges):
    ordered = sorted((rs, q, re, g, a) for g, q, rs, re, a in ranges)
    return [(g, c, s, e, next((ra for rs, _, re, k, ra in ordered if k == g and rs <= (s + e) / 2 < re), a)) for g, c, s, e, a in pieces]


@pytest.mark.parametrize("few", [10 ** 6, 0])
def test_cut_and_angles(spark, few, monkeypatch):
    """Ranges from one frame to a whole recording, clips that overlap, and cuts far apart."""
    monkeypatch.setattr(limits, "FEW_BUCKETS", few)
    rnd = random.Random(4)
    ranges = []
    for q in range(160):
        start = rnd.randrange(0, 300000)
        ranges.append((q % 2, q, start, start + rnd.choice([1, 2, 7, 780, 5000, 299999]), q % 5))
    ranges += [(2, 0, 0, 4 ** 10 + 3, 1), (2, 1, 0, 4 ** 10 + 3, 2), (2, 2, 5, 6, 3)]
    clips = [(g, c, c * 9000, c * 9000 + length, None if c % 2 else 9) for g in range(4) for c, length in enumerate([9000, 1, 30000, 12001, 9000, 8000, 1200000])]
    points = {(g, x) for g, _, s, e, _ in ranges for x in (s, e)}
    cdf = spark.createDataFrame(clips, "game_id int, clip_id long, start_frame long, end_frame long, angle int")
    rdf = spark.createDataFrame(ranges, "game_id int, seq long, start_frame long, end_frame long, angle int")
    pdf = TL.split_points(rdf)
    assert {tuple(r) for r in pdf.collect()} == points and pdf.count() == len(points)
    pieces = TL.split_clips(cdf, pdf)
    want = brute_pieces(clips, points)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r) for r in pieces.collect()), key=key) == sorted(want, key=key)
    got = TL.assign_angles(pieces, rdf).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_angles(want, ranges), key=key)


def test_midpoint_on_a_range_end(spark):
    ranges = spark.createDataFrame([(0, 1, 10, 20, 1), (0, 2, 20, 30, 2)], "game_id int, seq long, start_frame long, end_frame long, angle int")
    clips = spark.createDataFrame([(0, 1, 15, 25), (0, 2, 14, 25), (0, 3, 0, 20), (0, 4, 40, 41)], "game_id int, clip_id long, start_frame long, end_frame long")
    assert {r.clip_id: r.angle for r in TL.assign_angles(clips, ranges).collect()} == {1: 2, 2: 1, 3: 1, 4: None}


def test_conform_without_ranges(spark):
    clips = spark.createDataFrame([(0, 1, 0, 50, 3)], "game_id int, clip_id long, start_frame long, end_frame long, angle int")
    markers = spark.createDataFrame([], MARKER)
    assert [tuple(r) for r in conform_timeline(markers, clips, 60).select("clip_id", "start_frame", "end_frame", "angle").collect()] == [(1, 0, 50, 3)]


def test_merge_is_idempotent(spark):
    src = spark.createDataFrame([(0, 1, 5, "a", "n", "Red", 0), (0, 2, 5, "a", "n", "Red", 1), (0, 3, 6, None, None, None, None), (1, 1, 5, "a", "n", "Red", 2)], MARKER)
    dst = spark.createDataFrame([(0, 9, 6, "", "", "Blue", 1), (0, 8, 7, "z", "", "Blue", 1), (2, 1, 1, "k", "", "Blue", 1)], MARKER)
    merged = TL.merge_markers(src, dst)
    rows = sorted(map(tuple, merged.collect()))
    assert rows == [(0, 5, "Red", "a", "n", 1), (0, 6, "Blue", "", "", 1), (0, 7, "Blue", "z", "", 1), (1, 5, "Red", "a", "n", 2), (2, 1, "Blue", "k", "", 1)]
    assert {r.game_id: (r.copied, r.skipped) for r in TL.merge_counts(src, dst).collect()} == {0: (1, 2), 1: (1, 0)}
    again = merged.withColumn("seq", F.lit(0))
    assert sorted(map(tuple, TL.merge_markers(src, again).collect())) == rows
    assert TL.merge_markers(src, dst, dedupe=False).count() == 7
    replaced = sorted(map(tuple, TL.replace_markers(src, dst).collect()))
    assert replaced == [(0, 5, "Red", "a", "n", 1), (0, 6, "Blue", "", "", 1), (1, 5, "Red", "a", "n", 2), (2, 1, "Blue", "k", "", 1)]


def test_long_ranges_and_repeated_clips(spark):
    """A range of decades still reaches its clips, and equal clips stay apart."""
    markers = spark.createDataFrame([(0, 1, 5, "PLAY cam2", "win=900000000s", "Blue", 1), (0, 2, 6, "PLAY cam3000000000", "win=1s", "Blue", 1), (0, 3, 7, "PLAY", "win=99999999999999999999s", "Blue", 1)], MARKER)
    ranges = TL.expand_markers(markers, 60)
    assert sorted((r.seq, r.duration, r.angle) for r in ranges.collect()) == [(1, 54_000_000_000, 1), (2, 60, 0)]
    clips = spark.createDataFrame([(0, i, 10 ** i, 10 ** i + 10) for i in range(1, 11)] * 2, "game_id int, clip_id long, start_frame long, end_frame long")
    got = sorted((r.clip_id, r.angle) for r in TL.assign_angles(clips, ranges).collect())
    assert got == sorted([(i, 1) for i in range(1, 11)] * 2)


def test_bins_are_folded_alike_at_every_size(spark, monkeypatch):
    """One window over all bins, or levels of blocks."""
    rng = random.Random(3)
    ranges = spark.createDataFrame([(0, s, a, a + rng.choice([5, 400, 10 ** 9, 2 ** 50]), rng.randint(0, 3)) for s in range(80) for a in [rng.choice([1, 10 ** 4, 10 ** 8, 10 ** 12]) * rng.randint(0, 300)]],
                                   "game_id int, seq long, start_frame long, end_frame long, angle int")
    clips = spark.createDataFrame([(0, i, 40 ** (i % 9) + i, 40 ** (i % 9) + i + 33 ** (i % 7)) for i in range(80)], "game_id int, clip_id long, start_frame long, end_frame long")
    build = lambda: sorted(map(repr, TL.assign_angles(TL.split_clips(clips, TL.split_points(ranges)), ranges).collect()))
    want = build()
    monkeypatch.setattr(limits, "FEW_BUCKETS", 0)
    assert build() == want and len(want) > 200


def test_wide_clips_make_no_more_rows_than_pieces(spark, monkeypatch):
    """A clip of 2^50 frames is never spread over its length."""
    spread = []
    real = TL.explode_range

    def counted(*args):
        out = real(*args)
        spread.append(out.count())
        return out

    monkeypatch.setattr(TL, "explode_range", counted)
    points = [(0, 7), (0, 10 ** 6), (0, 2 ** 49), (0, 2 ** 50 - 1), (0, 2 ** 50), (1, 5)]
    clips = [(0, 1, 0, 2 ** 50, 1), (0, 2, 7, 8, 2), (0, 3, 6, 8, 3), (1, 1, 0, 2 ** 51, 4), (2, 1, 0, 2 ** 50, 5), (0, 4, 9, 9, 6), (0, 5, None, 9, 7)]
    got = TL.split_clips(spark.createDataFrame(clips, "game_id int, clip_id long, start_frame long, end_frame long, angle int"), spark.createDataFrame(points, "game_id int, frame long"))
    want = brute_pieces([c for c in clips if c[2] is not None], points) + [clips[-1]]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert spread == [6]


def test_ranges_that_begin_together(spark):
    """The first by seq, then angle; a range without an angle leaves the clip's."""
    ranges = spark.createDataFrame([(0, 2, 10, 90, 1), (0, 1, 10, 40, 2), (0, 1, 10, 50, 3), (0, 0, 60, 95, 4), (1, 1, 0, 9, None)], "game_id int, seq long, start_frame long, end_frame long, angle int")
    clips = spark.createDataFrame([(0, m, m, m, 9) for m in (9, 10, 39, 40, 49, 50, 60, 89, 90, 94, 95)] + [(1, 3, 3, 3, 9)], "game_id int, clip_id long, start_frame long, end_frame long, angle int")
    got = {(r.game_id, r.clip_id): r.angle for r in TL.assign_angles(clips, ranges).collect()}
    assert got == {(0, 9): 9, (0, 10): 2, (0, 39): 2, (0, 40): 3, (0, 49): 3, (0, 50): 1, (0, 60): 1, (0, 89): 1, (0, 90): 4, (0, 94): 4, (0, 95): 9, (1, 3): 9}

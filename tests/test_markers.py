import random

import pytest
from pyspark.sql import functions as F

from peakline import DetectConfig
from peakline.functions import text as TX
from peakline.functions import timecode as TC
from peakline.operators import limits
from peakline.operators import markers as M
from peakline.operators.chunks import floor_div, number_rows
from peakline.sources import tables as TB


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize("decimals", [0, 1, 2, 3, 4])
def test_fixed_prints_like_exact_rounding(spark, decimals):
    rnd = random.Random(decimals)
    xs = [0.15, 0.25, 0.125, 2.5, 0.5, 1.005, 0.045, 1e-9, 12345.6785, 0.0, 99.95, 2.675, -1.25] + [rnd.randrange(10 ** 6) / 10 ** rnd.randrange(1, 6) for _ in range(300)]
    got = [r.x for r in spark.createDataFrame([(x,) for x in xs], "v double").select(TX.fixed(F.col("v"), decimals).alias("x")).collect()]
    assert got == [f"{x:.{decimals}f}" for x in xs]


def test_timecodes(spark):
    df = spark.createDataFrame([(-5,), (0,), (59,), (60,), (216000,), (100 * 216000 + 61,)], "f long")
    tc = TC.frames_to_tc(F.col("f"), 60)
    rows = df.select(tc.alias("tc"), TC.tc_to_frames(tc, 60).alias("back"), "f").collect()
    assert [r.tc for r in rows] == ["00:00:00:00", "00:00:00:00", "00:00:00:59", "00:00:01:00", "01:00:00:00", "100:00:01:01"]
    assert all(r.back == max(0, r.f) for r in rows)


@pytest.mark.parametrize("fps", [1, 24, 30, 60])
def test_rational_time(spark, fps):
    from math import gcd

    frames = [0, 1, 7, 60, 90, 120, 12345]
    got = [r.x for r in spark.createDataFrame([(f,) for f in frames], "f long").select(TC.rational_time(F.col("f"), fps).alias("x")).collect()]
    for f, text in zip(frames, got):
        n, d = f // gcd(f, fps), fps // gcd(f, fps)
        assert text == ("0s" if f == 0 else f"{n}s" if d == 1 else f"{n}/{d}s")


def test_note_parsing(spark):
    notes = ["score=1 WIN = 5s", "win=2.5s win=9s", "win=3", "rewin=4s", "", None, "win=1e3s", "x win=13.0s, y"]
    got = [r.x for r in spark.createDataFrame([(n,) for n in notes], "n string").select(TX.parse_win_seconds(F.col("n")).alias("x")).collect()]
    assert got == [5.0, 2.5, None, None, None, None, None, 13.0]
    pairs = [("[rED] a", "[blue]"), ("a", "[oRange] x"), ("[1]", None), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.x for r in df.select(TX.parse_color(F.col("a"), F.col("b")).alias("x")).collect()] == ["Red", "Orange", "Blue", "Blue"]
    pairs = [("PLAY cam2", "cam9"), ("PLAY", "CAM3"), ("xcam4", "cam"), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.x for r in df.select(TX.parse_cam_angle(F.col("a"), F.col("b")).alias("x")).collect()] == [1, 2, 0, 0]


def test_labels(spark):
    rows = [("Red", "PLAY", "n" * 109), ("Red", "PLAY", "n" * 108), ("", "", ""), ("", "a\nb", ""), ("Blue", "", " x ")]
    got = [r.x for r in spark.createDataFrame(rows, "c string, n string, t string").select(TX.marker_label(F.col("c"), F.col("n"), F.col("t")).alias("x")).collect()]
    assert got == [("[Red] PLAY " + "n" * 109), "[Red] PLAY " + "n" * 108, "", "a b", "[Blue]  x"]
    long = one(spark, TX.marker_label(F.lit("Red"), F.lit("PLAY"), F.lit("n" * 110)))
    assert long == ("[Red] PLAY " + "n" * 110)[:117] + "..." and len(long) == 120
    assert one(spark, TX.xml_escape(F.lit('a&b "<c>" &amp;'))) == "a&amp;b &quot;&lt;c&gt;&quot; &amp;amp;"
    assert one(spark, TX.tag_note(F.lit("Red"), F.lit("  "))) == "[Red]"


RAW = "game_id int, seq long, Frame string, Name string, Note string, Color string, Duration string"


def test_normalize_and_events_disagree_on_length(spark):
    rows = [(0, 1, " 12.9 ", "PLAY cam1", "win=0.3s", "", "100"), (0, 2, "inf", "x", "", "", "1"), (0, 3, "nan", "x", "", "", "1"), (0, 4, "x", "", "", "", ""),
            (0, 5, "1e2", "Replay", "win=9s", "Red", "n/a"), (0, 6, "5", "PLAY", "win=0.0s", " ", "-4"), (0, 7, "5", None, None, None, None), (0, 8, "-3.7", "PLAY", "win=2.5s", "Red", "1.9")]
    df = spark.createDataFrame(rows, RAW)
    got = [(r.seq, r.frame, r.color, r.duration) for r in M.normalize_markers(df, 60).orderBy("seq").collect()]
    assert got == [(1, 12, "Blue", 100), (5, 100, "Red", 540), (6, 5, "Blue", 1), (7, 5, "Blue", 1), (8, -3, "Red", 1)]
    events = [(r.event_no, r.in_frame, r.out_frame, r.label) for r in M.to_edl_events(df, 60).orderBy("event_no").collect()]
    assert events == [(1, -3, 147, "[Red] PLAY win=2.5s"), (2, 5, 6, "PLAY win=0.0s"), (3, 5, 6, ""), (4, 12, 30, "PLAY cam1 win=0.3s"), (5, 100, 101, "[Red] Replay win=9s")]


@pytest.mark.parametrize("small", [10 ** 6, 0])
def test_numbering(spark, small, monkeypatch):
    monkeypatch.setattr(limits, "SMALL_GROUP", small)
    rnd = random.Random(2)
    rows = [(g, rnd.randrange(-50, 2000), s * 40000) for g in range(3) for s in range(200)]
    df = spark.createDataFrame(rows, "game_id int, frame long, seq long")
    got = M.number_by_frame(df, "frame", "no").collect()
    for g in range(3):
        mine = sorted((r.no, r.frame, r.seq) for r in got if r.game_id == g)
        assert [r[1:] for r in mine] == sorted((f, s) for k, f, s in rows if k == g) and [r[0] for r in mine] == list(range(1, 201))
    one_level = number_rows(df, ["game_id"], [("_b", floor_div(F.col("seq"), 65536))], ["seq"], "no").collect()
    assert all(r.no == r.seq // 40000 + 1 for r in one_level)


def scored(spark):
    rows = [(0, 1, 0.0, 13.0, 1.42, 1, 0.31), (0, 2, 20.0, 20.5, 0.5, 2, 0.125), (1, 1, 0.0, 40.0, 1.7, 1, 1.0)]
    return spark.createDataFrame(rows, "game_id int, window_id long, start_s double, end_s double, score double, primary_cam int, conf double")


def test_markers_round_trip(spark, tmp_path):
    cfg = DetectConfig.live()
    markers = M.replay_markers(scored(spark), cfg)
    path = str(tmp_path / "markers")
    TB.write_markers(markers, path)
    raw = TB.read_markers(spark, path)
    got = [(r.game_id, r.Frame, r.Name, r.Note, r.Color, r.Duration) for r in raw.orderBy("game_id", "seq").collect()]
    assert got == [
        (0, "0", "PLAY cam1", "score=1.42 conf=0.31 win=13.0s", "Orange", "780"),
        (0, "840", "REPLAY", "after=1.0s from end | PLAY cam1 | score=1.42 conf=0.31 win=13.0s", "Orange", "1"),
        (0, "1200", "PLAY cam2", "score=0.50 conf=0.12 win=0.5s", "Blue", "30"),
        (1, "0", "PLAY cam1", "score=1.70 conf=1.00 win=40.0s", "Red", "2400"),
        (1, "2460", "REPLAY", "after=1.0s from end | PLAY cam1 | score=1.70 conf=1.00 win=40.0s", "Red", "1")]
    assert M.normalize_markers(raw, 60).drop("seq").exceptAll(markers.drop("seq")).isEmpty()


def test_event_table(spark, tmp_path):
    path = str(tmp_path / "events")
    TB.write_events(scored(spark), path)
    lines = [line for part in sorted((tmp_path / "events" / "game_id=0").glob("part-*")) for line in part.read_text().splitlines()]
    assert [x for x in lines if not x.startswith("start_s")] == ["0.000,13.000,1.4200,1,0.3100", "20.000,20.500,0.5000,2,0.1250"]


def test_read_markers_needs_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Frame ;Name;Note;Color; Duration\n 5 ; PLAY ;n;Red;3\nbad;x;;;\n")
    row = TB.read_markers(spark, str(tmp_path / "a.csv"), sep=";").collect()
    assert [(r.Frame, r.Name, r.Duration) for r in row] == [("5", "PLAY", "3")]
    (tmp_path / "b.csv").write_text("Frame,Name\n1,a\n")
    with pytest.raises(ValueError, match="Color"):
        TB.read_markers(spark, str(tmp_path / "b.csv"))


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 90, 'a "b"', "", "Red", 60), (0, 2, 0, "PLAY", "n & m", "", 1)],
                               "game_id int, seq long, frame long, name string, note string, color string, duration long")
    lines = M.fcpxml_lines(df, 60)
    TB.write_fcpxml(lines, str(tmp_path / "xml"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "xml" / "game_id=0").glob("part-*"))).splitlines()
    assert len(text) == 11 + 2 + 7 and text[0].startswith("<?xml") and text[-1] == "</fcpxml>"
    assert text[11] == '              <marker start="0s" duration="1/60s" value="PLAY" note="[Blue] n &amp; m"/>'
    assert text[12] == '              <marker start="3/2s" duration="1s" value="a &quot;b&quot;" note="[Red]"/>'
    assert 'duration="13/2s" tcStart' in text[8]
    import xml.dom.minidom

    xml.dom.minidom.parseString("\n".join(text))
    with pytest.raises(ValueError):
        TB.write_fcpxml(M.fcpxml_lines(df.filter("false"), 60), str(tmp_path / "none"))


def test_edl_of_a_game_without_events(spark):
    events = spark.createDataFrame([(0, 1, 60, 120, "x")], "game_id int, event_no long, in_frame long, out_frame long, label string")
    games = spark.createDataFrame([(0,), (1,)], "game_id int")
    got = {g: [r.line for r in M.edl_lines(events, 60, games=games).orderBy("line_no").collect() if r.game_id == g] for g in (0, 1)}
    assert got[1] == ["TITLE: HOCKEY_WINDOWS", "FCM: NON-DROP FRAME", ""]
    assert got[0][3:] == ["001  AX       V     C        01:00:01:00 01:00:02:00 01:00:01:00 01:00:02:00", "* LOC: 01:00:01:00  NAME: x", "* COMMENT: x", ""]


def test_line_breaks_and_free_file_names(spark, tmp_path):
    rows = [(1, i, 10 * i, "PLAY", f'line "one"\nline, {i} win=3.0s', "Red", i + 1) for i in range(20)] + [(2, 1, 3, "PLAY", "plain", "Blue", 1)]
    TB.write_markers(spark.createDataFrame(rows, "game_id int, seq long, frame long, name string, note string, color string, duration long"), str(tmp_path / "out"))
    got = sorted((r.game_id, r.seq, int(r.Frame), r.Note, r.Color, int(r.Duration)) for r in TB.read_markers(spark, str(tmp_path / "out")).collect())
    assert [(g, f, n, c, d) for g, _, f, n, c, d in got] == [(g, f, n, c, d) for g, _, f, _, n, c, d in rows]
    folder = tmp_path / "free" / "game_id=1"
    folder.mkdir(parents=True)
    for name, start in (("b.csv", 50), ("a.csv", 90)):
        (folder / name).write_text("Frame,Name,Note,Color,Duration\n" + "".join(f"{start + i},x,,,1\n" for i in range(3)))
    seqs = {int(r.Frame): r.seq for r in TB.read_markers(spark, str(tmp_path / "free")).collect()}
    assert len(set(seqs.values())) == 6 and sorted(seqs, key=seqs.get) == [90, 91, 92, 50, 51, 52]


def test_bad_rows_stop_nothing(spark):
    raw = spark.createDataFrame([(0, 1, "1", "PLAY cam3000000000", "win=99999999999999999999s", "", "9e99"), (0, 2, "99999999999999999999", "x", "", "", "1"), (0, 3, "inf", "x", "", "", "1")],
                                "game_id int, seq long, Frame string, Name string, Note string, Color string, Duration string")
    assert [tuple(r)[2:] for r in M.normalize_markers(raw, 60).collect()] == [(1, "PLAY cam3000000000", "win=99999999999999999999s", "Blue", 1)]
    assert [(r.in_frame, r.out_frame) for r in M.to_edl_events(raw, 60).collect()] == [(1, 2)]
    assert raw.select(TX.parse_cam_angle(F.col("Name"), F.col("Note")).alias("a")).first().a == 0


def test_no_level_of_the_numbering_is_large(spark, monkeypatch):
    """Sparse markers: no window spans more than 4,096 buckets, at any level, nor as many rows."""
    df = spark.range(20_000).select(F.lit(0).alias("game_id"), F.col("id").alias("seq"), (F.col("id") * 720 + (F.col("id") % 7) * 2 ** 34).alias("frame"))
    levels = [F.floor(F.col("frame") / 2 ** bits) for bits in (44, 32, 20, 8)] + [F.col("frame")]
    for depth in range(len(levels)):
        above = df.select(*[c.alias(f"l{i}") for i, c in enumerate(levels[:depth + 1])]).distinct()
        assert above.groupBy(*[f"l{i}" for i in range(depth)]).count().agg(F.max("count")).first()[0] <= 4096
    monkeypatch.setattr(limits, "SMALL_GROUP", 0)
    got = [r.seq for r in M.number_by_frame(df, "frame", "no").orderBy("no").select("seq").collect()]
    assert got == [r.seq for r in df.orderBy("frame", "seq").collect()]


def test_fixed_has_a_rule_for_every_double(spark):
    xs = [float("nan"), float("inf"), float("-inf"), 2.0 ** 53, -(2.0 ** 55), 2.0 ** 51, None]
    got = [r.x for r in spark.createDataFrame([(x,) for x in xs], "v double").select(TX.fixed(F.col("v"), 2).alias("x")).collect()]
    assert got == ["nan", "inf", "-inf", f"{2 ** 53}.00", f"-{2 ** 55}.00", f"{2 ** 51}.00", None]

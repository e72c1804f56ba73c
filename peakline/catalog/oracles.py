"""DuckDB SQL for every registered query, written from the semantics and not from the Spark plans.

`CTES` are the shared steps in order; a query names the ones it needs and `sql` adds them.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

# Fixtures ----------------------------------------------------------------------------------------

CTES["fx_events"] = """
SELECT CAST(user_id // 38 AS INT) AS game_id, CAST(1 + event_id % 2 AS INT) AS cam,
       CAST(FLOOR(EPOCH(ts)) AS BIGINT) - 1704067200 AS t_s, event_type, CAST(value AS DECIMAL(18,2)) AS v
FROM events"""
CTES["fx_bins"] = """
SELECT game_id, cam, t_s // 600 AS idx,
  SUM(CASE WHEN event_type IN ('click','purchase') THEN v ELSE 0 END) AS net,
  SUM(CASE WHEN event_type IN ('view','signup') THEN v ELSE 0 END) AS slot,
  SUM(CASE WHEN event_type = 'error' THEN v ELSE 0 END) AS audio
FROM fx_events GROUP BY ALL"""
CTES["fx_grid"] = """
SELECT game_id, cam, UNNEST(RANGE(0, (SELECT MAX(idx) + 1 FROM fx_bins))) AS idx FROM (SELECT DISTINCT game_id, cam FROM fx_events)"""
CTES["fx_signals"] = """
SELECT g.game_id, g.cam, g.idx, CAST(COALESCE(s.net, 0) AS DOUBLE) AS net,
       CAST(COALESCE(s.slot, 0) AS DOUBLE) AS slot, CAST(COALESCE(s.audio, 0) AS DOUBLE) AS audio
FROM fx_grid g LEFT JOIN fx_bins s ON g.game_id = s.game_id AND g.cam = s.cam AND g.idx = s.idx"""
CTES["fx_markers_raw"] = """
SELECT CAST(user_id // 38 AS INT) AS game_id, event_id AS seq,
  CASE WHEN event_id % 50 = 0 THEN 'bad' WHEN event_id % 1013 = 7 THEN '99999999999999999999'
       WHEN event_id % 7 = 0 THEN CONCAT(CAST((event_id*37) % 100000 AS VARCHAR), '.9')
       ELSE CAST((event_id*37) % 100000 AS VARCHAR) END AS "Frame",
  CASE WHEN event_type='error' THEN 'replay' WHEN event_id % 997 = 5 THEN 'PLAY cam3000000000' ELSE CONCAT('PLAY cam', CAST(1 + user_id % 2 AS VARCHAR)) END AS "Name",
  CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '[red] & "x" <y>'
       WHEN event_id % 991 = 3 THEN 'win=900000000s' WHEN event_id % 983 = 4 THEN 'win=1e9s win=300000000000000000s'
       WHEN event_id % 977 = 6 THEN CONCAT('line "one"', chr(10), 'line two win=3.0s')
       ELSE CONCAT('score=1.20 conf=0.40 win=', CAST(event_id % 30 AS VARCHAR), '.', CAST(event_id % 10 AS VARCHAR), 's') END AS "Note",
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Blue' WHEN 2 THEN 'Yellow' WHEN 3 THEN 'Orange' ELSE 'Red' END AS "Color",
  CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(event_id % 1500 AS VARCHAR) END AS "Duration"
FROM events"""
CTES["fx_paths"] = """
SELECT CONCAT('/games/', CAST(user_id AS VARCHAR), '/g', CAST(event_id AS VARCHAR), '_cam', CAST(1 + event_id % 3 AS VARCHAR), '.mp4') AS path
FROM events"""
CTES["fx_audio"] = """
SELECT 0 AS game_id, 1 AS cam, event_id AS sample_idx, CAST(FLOOR(CAST(value AS DECIMAL(18,2))*100) AS INT) - 5000 AS amp FROM events"""
CTES["fx_corners"] = """
SELECT l_orderkey, l_linenumber, CAST(l_partkey % 2200 - 100 AS INT) AS x1, CAST(l_suppkey*13 % 1300 - 50 AS INT) AS y1,
       CAST(l_orderkey*7 % 2200 - 100 AS INT) AS x2, CAST((l_orderkey*97 + l_linenumber) % 1300 - 50 AS INT) AS y2 FROM lineitem"""
CTES["fx_rois"] = """
SELECT CAST(p_partkey // 4 AS INT) AS game_id, CAST(1 + p_partkey % 4 // 2 AS INT) AS cam,
       CASE WHEN p_partkey % 2 = 0 THEN 'net' ELSE 'slot' END AS roi,
       CAST(p_partkey*37 % 2100 - 80 AS INT) AS x, CAST(p_partkey*53 % 1200 - 60 AS INT) AS y,
       CAST(p_partkey*11 % 900 AS INT) AS w, CAST(p_partkey*7 % 700 - 20 AS INT) AS h
FROM part"""
CTES["fx_frames"] = """
SELECT 0 AS game_id, CAST(1 + vec_id % 2 AS INT) AS cam, vec_id // 2 AS frame_idx, 8 AS width, 8 AS height,
  list_transform(embedding, lambda e: CAST(GREATEST(0, LEAST(255, FLOOR((CAST(e AS DOUBLE) + 0.5) * 255))) AS INT)) AS pixels,
  list_transform(embedding, lambda e: ABS(e)) AS mag
FROM embeddings"""
CTES["fx_frame_rois"] = """
SELECT 0 AS game_id, cam, roi, x, y, w, h FROM
  (VALUES (1), (2)) c(cam), (VALUES ('net', 2, 2, 3, 3), ('slot', 5, 5, 3, 3)) r(roi, x, y, w, h)"""

# Signals -----------------------------------------------------------------------------------------

CTES["flow"] = "SELECT *, 0.7::DOUBLE * net + 0.3::DOUBLE * slot AS flow FROM fx_signals"
CTES["flow_scale"] = """
SELECT game_id, cam, quantile_cont(flow, 0.99) AS pf, quantile_cont(audio, 0.99) AS pa FROM flow GROUP BY ALL"""
CTES["fused"] = """
SELECT f.*, 0.8::DOUBLE * (flow / (pf + 1e-6)) + 0.2::DOUBLE * (audio / (pa + 1e-6)) AS raw
FROM flow f JOIN flow_scale USING (game_id, cam)"""
CTES["smoothed"] = """
SELECT *, round_even((SUM(raw) OVER (PARTITION BY game_id, cam ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2.0) * 1e9, 0) / 1e9 AS smooth
FROM fused"""
CTES["series"] = """
SELECT game_id, cam, COUNT(*) AS n, quantile_cont(smooth, 0.70) AS floor70, quantile_cont(smooth, 0.99) AS p99,
       quantile_cont(smooth, 0.95) AS p95 FROM smoothed GROUP BY ALL"""
CTES["segments"] = """
SELECT game_id, cam, idx // 1200 AS seg, quantile_cont(smooth, 0.95) AS q FROM smoothed GROUP BY ALL"""
CTES["attack"] = """
SELECT s.*, GREATEST(q, floor70) AS threshold FROM smoothed s JOIN series USING (game_id, cam)
JOIN segments g ON g.game_id = s.game_id AND g.cam = s.cam AND g.seg = s.idx // 1200"""

_RUNS = """
SELECT {keys}, run, MIN(idx) AS l, MAX(idx) AS r, ANY_VALUE(smooth) AS value FROM (
  SELECT *, SUM(chg) OVER (PARTITION BY {keys} ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN smooth = LAG(smooth) OVER (PARTITION BY {keys} ORDER BY idx) THEN 0 ELSE 1 END AS chg FROM {table}))
GROUP BY {keys}, run"""
_TOPS = """
SELECT {keys}, (l + r) // 2 AS idx, l AS "left", r AS "right", value FROM (
  SELECT *, LAG(value) OVER (PARTITION BY {keys} ORDER BY run) AS pv, LEAD(value) OVER (PARTITION BY {keys} ORDER BY run) AS nv FROM {table})
WHERE pv < value AND nv < value"""
_GREEDY = """
SELECT {keys}, rn, [pos] AS kept FROM {table} WHERE rn = 1
UNION ALL
SELECT {tkeys}, t.rn, CASE WHEN len(list_filter(g.kept, lambda k: abs(k - t.pos) < {distance})) = 0 THEN list_append(g.kept, t.pos) ELSE g.kept END
FROM {name} g JOIN {table} t ON {match} AND t.rn = g.rn + 1"""


def _greedy(name: str, table: str, keys: tuple[str, ...], distance: float) -> None:
    CTES[name] = _GREEDY.format(name=name, table=table, keys=", ".join(keys), tkeys=", ".join(f"t.{k}" for k in keys),
                                distance=distance, match=" AND ".join(f"t.{k} = g.{k}" for k in keys))
    CTES[name + "_kept"] = f"""
SELECT {', '.join(keys)}, UNNEST(kept) AS pos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {', '.join(keys)} ORDER BY rn DESC) AS z FROM {name}) WHERE z = 1"""


CTES["runs"] = _RUNS.format(keys="game_id, cam", table="smoothed")
CTES["tops"] = _TOPS.format(keys="game_id, cam", table="runs")


def _detector(v: str, threshold: str, source: str, fps: int = 4, distance: int = 48, gap: float = 0.0, drop: int = 8, near: int = 2,
              longest: float = 20.0, cooldown: float = 12.0) -> None:
    """Peaks to events for one detector run; `source` has (game_id, cam, idx, smooth)."""
    series = "series" if v == "2" else f"series{v}"
    tops = "tops" if v == "2" else f"tops{v}"
    CTES[f"cand{v}"] = f"""
SELECT t.game_id, t.cam, t.idx, t.idx AS pos, t.value, ROW_NUMBER() OVER (PARTITION BY t.game_id, t.cam ORDER BY t.value DESC, t.idx DESC) AS rn
FROM {tops} t JOIN {threshold} WHERE n >= 10 AND t.value >= threshold"""
    _greedy(f"spaced{v}", f"cand{v}", ("game_id", "cam"), distance)
    CTES[f"peaks{v}"] = f"""
SELECT k.game_id, k.cam, k.pos AS idx, k.pos / {fps}.0 AS peak_s, c.value AS peak_val, k.pos / {fps}.0 - 7.0 AS start_s, k.pos / {fps}.0 + 6.0 AS end_s
FROM spaced{v}_kept k JOIN cand{v} c ON c.game_id = k.game_id AND c.cam = k.cam AND c.pos = k.pos"""
    CTES[f"merged{v}"] = f"""
SELECT game_id, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY MIN(start_s)) AS window_id, MIN(start_s) AS start_s, MAX(end_s) AS end_s FROM (
  SELECT *, SUM(o) OVER (PARTITION BY game_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_s <= MAX(end_s) OVER (PARTITION BY game_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS o
    FROM peaks{v}))
GROUP BY game_id, island"""
    CTES[f"clean{v}"] = f"""
SELECT game_id, window_id, GREATEST(0.0, start_s) AS start_s, GREATEST(GREATEST(0.0, start_s) + 0.5, end_s) AS end_s FROM merged{v}"""
    CTES[f"slices{v}"] = f"""
SELECT w.game_id, w.window_id, s.cam, s.idx, s.smooth FROM clean{v} w JOIN {source} s
ON s.game_id = w.game_id AND s.idx >= GREATEST(0, FLOOR(w.start_s * {fps})) AND s.idx < CEIL(w.end_s * {fps})"""
    CTES[f"maxima{v}"] = f"""
SELECT game_id, window_id, cam, COUNT(*) AS n, MAX(smooth) AS m, arg_min(idx, (-smooth, idx)) AS argmax FROM slices{v} GROUP BY ALL"""
    CTES[f"drops{v}"] = f"""
SELECT x.game_id, x.window_id, x.cam, x.m - MIN(s.smooth) AS drop_v FROM maxima{v} x JOIN {source} s
ON s.game_id = x.game_id AND s.cam = x.cam AND s.idx >= x.argmax AND s.idx < x.argmax + {drop} GROUP BY x.game_id, x.window_id, x.cam, x.m"""
    CTES[f"wruns{v}"] = _RUNS.format(keys="game_id, window_id, cam", table=f"slices{v}")
    CTES[f"wtops{v}"] = _TOPS.format(keys="game_id, window_id, cam", table=f"wruns{v}")
    CTES[f"wcand{v}"] = f"""
SELECT t.game_id, t.window_id, t.cam, t.idx AS pos, ROW_NUMBER() OVER (PARTITION BY t.game_id, t.window_id, t.cam ORDER BY t.value DESC, t.idx DESC) AS rn
FROM wtops{v} t JOIN maxima{v} x USING (game_id, window_id, cam) WHERE x.n > 5 AND t.value >= x.m * 0.80::DOUBLE"""
    _greedy(f"wspaced{v}", f"wcand{v}", ("game_id", "window_id", "cam"), near)
    CTES[f"rebounds{v}"] = f"""
SELECT x.game_id, x.window_id, x.cam, LEAST(3, COALESCE(c, 0)) / 3.0::DOUBLE AS rebound FROM maxima{v} x LEFT JOIN
  (SELECT game_id, window_id, cam, COUNT(*) AS c FROM wspaced{v}_kept GROUP BY ALL) USING (game_id, window_id, cam)"""
    CTES[f"stats{v}"] = f"""
SELECT x.game_id, x.window_id, x.cam, x.m, x.n, x.argmax, d.drop_v, r.rebound, s.p99 FROM maxima{v} x
JOIN drops{v} d USING (game_id, window_id, cam) JOIN rebounds{v} r USING (game_id, window_id, cam) JOIN {series} s USING (game_id, cam)"""
    CTES[f"chosen{v}"] = f"""
SELECT *, CASE WHEN m1 >= m2 THEN 1 ELSE 2 END AS primary_cam, ABS(m1 - m2) / (m1 + m2 + 1e-6) AS conf FROM (
  SELECT w.game_id, w.window_id, w.start_s, w.end_s, COALESCE(a.m, 0.0) AS m1, COALESCE(b.m, 0.0) AS m2,
    a.drop_v AS d1, b.drop_v AS d2, a.rebound AS r1, b.rebound AS r2, a.p99 AS p1, b.p99 AS p2
  FROM clean{v} w LEFT JOIN stats{v} a ON a.game_id = w.game_id AND a.window_id = w.window_id AND a.cam = 1
  LEFT JOIN stats{v} b ON b.game_id = w.game_id AND b.window_id = w.window_id AND b.cam = 2)"""
    CTES[f"scored{v}"] = f"""
SELECT *, CASE WHEN score > 1.60 THEN 'Red' WHEN score > 1.30 THEN 'Orange' WHEN score > 1.00 THEN 'Yellow' ELSE 'Blue' END AS color FROM (
  SELECT game_id, window_id, start_s, end_s, primary_cam, conf, base * (0.85::DOUBLE + 0.15::DOUBLE * conf) * CASE WHEN conf < 0.15 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS score FROM (
    SELECT *, 0.55::DOUBLE * GREATEST(0.0, m / (p + 1e-6)) + 0.25::DOUBLE * r + 0.20::DOUBLE * GREATEST(0.0, d / (p + 1e-6)) AS base FROM (
      SELECT *, CASE WHEN primary_cam = 1 THEN m1 ELSE m2 END AS m, COALESCE(CASE WHEN primary_cam = 1 THEN r1 ELSE r2 END, 0.0) AS r,
        COALESCE(CASE WHEN primary_cam = 1 THEN d1 ELSE d2 END, 0.0) AS d, COALESCE(CASE WHEN primary_cam = 1 THEN p1 ELSE p2 END, 1.0) AS p FROM chosen{v})))"""
    CTES[f"capped{v}"] = f"""
SELECT game_id, window_id, start_s, LEAST(end_s, start_s + CASE WHEN color IN ('Orange', 'Red') THEN 32.0 ELSE {longest} END) AS end_s,
  score, primary_cam, conf, color FROM scored{v}"""
    CTES[f"ranked{v}"] = f"SELECT *, start_s AS pos, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY score DESC, start_s) AS rn FROM capped{v}"
    if cooldown:
        _greedy(f"cooled{v}", f"ranked{v}", ("game_id",), cooldown)
        CTES[f"final{v}"] = f"SELECT c.* FROM capped{v} c JOIN cooled{v}_kept k ON k.game_id = c.game_id AND k.pos = c.start_s"
    else:
        CTES[f"final{v}"] = f"SELECT * FROM capped{v}"


_detector("2", "attack a ON a.game_id = t.game_id AND a.cam = t.cam AND a.idx = t.idx JOIN series s ON s.game_id = t.game_id AND s.cam = t.cam", "smoothed")

# Version 1: same fixture, no scaling, one threshold per series.
CTES["smoothed1"] = """
SELECT game_id, cam, idx, round_even((SUM(flow) OVER (PARTITION BY game_id, cam ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2.0) * 1e9, 0) / 1e9 AS smooth
FROM flow"""
CTES["series1"] = """
SELECT game_id, cam, COUNT(*) AS n, quantile_cont(smooth, 0.95) AS threshold, quantile_cont(smooth, 0.99) AS p99 FROM smoothed1 GROUP BY ALL"""
CTES["runs1"] = _RUNS.format(keys="game_id, cam", table="smoothed1")
CTES["tops1"] = _TOPS.format(keys="game_id, cam", table="runs1")
_detector("1", "series1 s ON s.game_id = t.game_id AND s.cam = t.cam", "smoothed1")

CTES["event_lines"] = """
SELECT game_id, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY score DESC, start_s) AS pos,
  CONCAT_WS(',', printf('%.3f', start_s), printf('%.3f', end_s), printf('%.4f', score), primary_cam, printf('%.4f', conf)) AS line FROM final2"""

# Markers -----------------------------------------------------------------------------------------

CTES["plays"] = """
SELECT game_id, window_id * 2 AS seq, end_s, CAST(round_even(start_s * 60.0, 0) AS BIGINT) AS frame, CONCAT('PLAY cam', primary_cam) AS name,
  CONCAT('score=', printf('%.2f', score), ' conf=', printf('%.2f', conf), ' win=', printf('%.1f', GREATEST(0.0, end_s - start_s)), 's') AS note,
  color, GREATEST(1, CAST(round_even(GREATEST(0.0, end_s - start_s) * 60.0, 0) AS BIGINT)) AS duration FROM final2"""
CTES["play_replay"] = """
SELECT game_id, seq, frame, name, note, color, duration FROM plays
UNION ALL
SELECT game_id, seq + 1, CAST(round_even((end_s + 1.0) * 60.0, 0) AS BIGINT), 'REPLAY', CONCAT('after=1.0s from end | ', name, ' | ', note), color, 1
FROM plays WHERE color IN ('Orange', 'Red')"""
_TYPED = r"""
SELECT *, TRY_CAST(round_even(win * 60, 0) AS BIGINT) AS wf FROM (
  SELECT game_id, seq, TRY_CAST(TRUNC(TRY_CAST("Frame" AS DOUBLE)) AS BIGINT) AS frame, TRIM("Name") AS name, TRIM("Note") AS note, TRIM("Color") AS color,
    CAST(TRUNC(TRY_CAST("Duration" AS DOUBLE)) AS BIGINT) AS dur, TRY_CAST(NULLIF(regexp_extract("Note", '(?i)\bwin\s*=\s*([0-9]+(?:\.[0-9]+)?)s\b', 1), '') AS DOUBLE) AS win
  FROM {table} WHERE ABS(TRY_CAST("Frame" AS DOUBLE)) <= 4503599627370496)"""
CTES["raw_typed"] = _TYPED.format(table="fx_markers_raw")
CTES["fx_markers"] = """
SELECT game_id, seq, frame, name, note, CASE WHEN color = '' THEN 'Blue' ELSE color END AS color,
  GREATEST(1, COALESCE(dur, wf, 1)) AS duration FROM raw_typed"""
_EDL_EVENTS = """
SELECT game_id, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY frame, seq) AS event_no, frame AS in_frame,
  frame + CASE WHEN UPPER(name) = 'REPLAY' OR wf IS NULL THEN 1 ELSE GREATEST(1, wf) END AS out_frame,
  CASE WHEN LENGTH(label) > 120 THEN CONCAT(LEFT(label, 117), '...') ELSE label END AS label
FROM (SELECT *, TRIM(CONCAT_WS(' ', CASE WHEN color <> '' THEN CONCAT('[', color, ']') END, NULLIF(name, ''), NULLIF(REPLACE(note, chr(10), ' '), ''))) AS label FROM {table})"""
CTES["edl_events"] = _EDL_EVENTS.format(table="raw_typed")
CTES["ranges"] = r"""
SELECT game_id, seq, frame, name, note,
  CONCAT(UPPER(LEFT(word, 1)), LOWER(SUBSTRING(word, 2))) AS color, length AS duration, frame + 3600 AS start_frame, frame + length + 3600 AS end_frame,
  COALESCE(TRY_CAST(NULLIF(regexp_extract(name, '(?i)\bcam([0-9]+)\b', 1), '') AS INT), TRY_CAST(NULLIF(regexp_extract(note, '(?i)\bcam([0-9]+)\b', 1), '') AS INT), 1) - 1 AS angle
FROM (SELECT *, GREATEST(1, TRY_CAST(round_even(win * 60, 0) AS BIGINT)) AS length,
        COALESCE(NULLIF(regexp_extract(name, '\[([A-Za-z]+)\]', 1), ''), NULLIF(regexp_extract(note, '\[([A-Za-z]+)\]', 1), ''), 'Blue') AS word
      FROM (SELECT *, TRY_CAST(NULLIF(regexp_extract(note, '(?i)\bwin\s*=\s*([0-9]+(?:\.[0-9]+)?)s\b', 1), '') AS DOUBLE) AS win FROM fx_markers)
      WHERE UPPER(name) <> 'REPLAY' AND win > 0 AND TRY_CAST(round_even(win * 60, 0) AS BIGINT) IS NOT NULL)"""
CTES["cuts"] = "SELECT DISTINCT game_id, UNNEST([start_frame, end_frame]) AS frame FROM ranges"
CTES["fx_clips"] = """
SELECT DISTINCT game_id, frame // 5000 AS clip_id, frame // 5000 * 5000 AS start_frame, (frame // 5000 + 1) * 5000 AS end_frame FROM fx_markers
UNION ALL SELECT DISTINCT m.game_id, w.clip_id, w.start_frame, w.end_frame FROM fx_markers m, (VALUES (-1, 0, 1125899906842624), (-2, 40000, 40001)) AS w(clip_id, start_frame, end_frame)"""
CTES["pieces"] = """
SELECT game_id, clip_id, edge AS start_frame, LEAD(edge) OVER (PARTITION BY game_id, clip_id ORDER BY edge) AS end_frame FROM (
  SELECT game_id, clip_id, start_frame AS edge FROM fx_clips
  UNION SELECT game_id, clip_id, end_frame FROM fx_clips
  UNION SELECT c.game_id, c.clip_id, p.frame FROM fx_clips c JOIN cuts p ON p.game_id = c.game_id AND p.frame > c.start_frame AND p.frame < c.end_frame)
QUALIFY end_frame IS NOT NULL"""
CTES["merge_src"] = """
SELECT * FROM fx_markers WHERE game_id % 2 = 0 AND seq % 2 = 0 UNION ALL SELECT * FROM fx_markers WHERE game_id % 2 = 0 AND seq % 10 = 0"""
CTES["merge_dst"] = "SELECT * FROM fx_markers WHERE seq % 3 = 0 OR seq % 2 = 1 OR game_id % 2 <> 0"
CTES["merge_new"] = """
SELECT DISTINCT game_id, frame, color, name, note, duration FROM merge_src
EXCEPT SELECT game_id, frame, color, name, note, duration FROM merge_dst"""
CTES["count_src"] = "SELECT * FROM fx_markers WHERE seq % 2 = 0 UNION ALL SELECT * FROM fx_markers WHERE seq % 10 = 0"
CTES["count_dst"] = "SELECT * FROM fx_markers WHERE seq % 3 = 0 OR seq % 2 = 1"
CTES["count_new"] = """
SELECT DISTINCT game_id, frame, color, name, note, duration FROM count_src
EXCEPT SELECT game_id, frame, color, name, note, duration FROM count_dst"""

_TC = "printf('%02d:%02d:%02d:%02d', {n} // 216000, {n} // 3600 % 60, {n} // 60 % 60, {n} % 60)"
_RATIONAL = ("CASE WHEN {n} = 0 THEN '0s' WHEN 60 // gcd({n}, 60) = 1 THEN CONCAT({n} // gcd({n}, 60), 's') "
             "ELSE CONCAT({n} // gcd({n}, 60), '/', 60 // gcd({n}, 60), 's') END")
_ESCAPED = "REPLACE(REPLACE(REPLACE(REPLACE({c}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"


def _spread(lines: list[str]) -> str:
    return "UNNEST([" + ", ".join(lines) + "])"


# The texts of the two interchange formats.
_EDL = f"""
SELECT game_id, 1 + UNNEST([0, 1, 2]) AS line_no, UNNEST(['TITLE: HOCKEY_WINDOWS', 'FCM: NON-DROP FRAME', '']) AS line FROM (SELECT DISTINCT game_id FROM edl_events)
UNION ALL
SELECT game_id, 4 + (event_no - 1) * 4 + UNNEST([0, 1, 2, 3]), UNNEST([CONCAT(printf('%03d', event_no), '  AX       V     C        ', a, ' ', b, ' ', a, ' ', b),
  CONCAT('* LOC: ', a, '  NAME: ', label), CONCAT('* COMMENT: ', label), '']) FROM (
  SELECT *, {_TC.format(n='(in_frame + 216000)')} AS a, {_TC.format(n='(out_frame + 216000)')} AS b FROM edl_events)"""
_XML_HEAD = """['<?xml version="1.0" encoding="UTF-8"?>', '<fcpxml version="1.4">', '  <resources>',
  '    <format id="r1" name="FFVideoFormat1080p60" frameDuration="1/60s" width="1920" height="1080" colorSpace="1-1-1 (Rec. 709)"/>',
  '  </resources>', '  <library>', '    <event name="markers">', '      <project name="AI Markers">',
  CONCAT('        <sequence format="r1" duration="', total, '" tcStart="0s" tcFormat="NDF">'), '          <spine>',
  CONCAT('            <gap name="Markers" offset="0s" start="0s" duration="', total, '">')]"""
_XML_FOOT = "['            </gap>', '          </spine>', '        </sequence>', '      </project>', '    </event>', '  </library>', '</fcpxml>']"
_XML = f"""
SELECT game_id, UNNEST(RANGE(1, 12)) AS line_no, UNNEST({_XML_HEAD}) AS line FROM (
  SELECT game_id, {_RATIONAL.format(n='(MAX(frame) + 300)')} AS total FROM fx_markers GROUP BY game_id)
UNION ALL
SELECT game_id, 11 + ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY frame, seq),
  CONCAT('              <marker start="', {_RATIONAL.format(n='frame')}, '" duration="', {_RATIONAL.format(n='duration')}, '" value="', {_ESCAPED.format(c='name')},
    '" note="', {_ESCAPED.format(c="CASE WHEN note = '' THEN CONCAT('[', color, ']') ELSE CONCAT('[', color, '] ', note) END")}, '"/>') FROM fx_markers
UNION ALL
SELECT game_id, 11 + n + UNNEST(RANGE(1, 8)), UNNEST({_XML_FOOT}) FROM (SELECT game_id, COUNT(*) AS n FROM fx_markers GROUP BY game_id)"""

_PIXEL_PAIRS = """
SELECT c.game_id, c.cam, c.frame_idx - 1 AS idx, c.pixels AS cur, p.pixels AS prev FROM fx_frames c
JOIN fx_frames p ON p.cam = c.cam AND p.frame_idx = c.frame_idx - 1"""
CTES["pixel_pairs"] = _PIXEL_PAIRS
CTES["pixels"] = """
SELECT game_id, cam, idx, (pos - 1) % 8 AS x, (pos - 1) // 8 AS y, ABS(cur[pos] - prev[pos]) AS d
FROM (SELECT *, UNNEST(RANGE(1, 65)) AS pos FROM pixel_pairs)"""
CTES["grid_pixels"] = """
SELECT game_id, cam, frame_idx AS idx, (pos - 1) % 8 AS x, (pos - 1) // 8 AS y, CAST(mag[pos] AS DOUBLE) AS m
FROM (SELECT *, UNNEST(RANGE(1, 65)) AS pos FROM fx_frames)"""
CTES["rms"] = """
SELECT game_id, cam, sample_idx // 100 AS k, (sample_idx // 100 + 0.5) * 0.5 AS t, SQRT(AVG(CAST(amp AS DOUBLE) * amp)) AS rms
FROM fx_audio GROUP BY game_id, cam, sample_idx // 100 HAVING COUNT(*) = 100 OR sample_idx // 100 = 0"""
CTES["audio_grid"] = """
SELECT game_id, cam, UNNEST(RANGE(0, CAST(FLOOR(n / 200.0 * 12) AS BIGINT))) AS idx FROM (SELECT game_id, cam, COUNT(*) AS n FROM fx_audio GROUP BY ALL)"""
CTES["audio_interp"] = """
SELECT g.game_id, g.cam, g.idx, CASE WHEN a.t IS NULL THEN b.rms WHEN b.t IS NULL THEN a.rms
  ELSE a.rms + (b.rms - a.rms) * ((g.idx / 12.0 - a.t) / (b.t - a.t)) END AS rms
FROM audio_grid g LEFT JOIN rms a ON a.game_id = g.game_id AND a.cam = g.cam AND a.k = LEAST(CAST(FLOOR(g.idx / 12.0 / 0.5 - 0.5) AS BIGINT), (SELECT MAX(k) FROM rms))
LEFT JOIN rms b ON b.game_id = g.game_id AND b.cam = g.cam AND b.k = CAST(FLOOR(g.idx / 12.0 / 0.5 - 0.5) AS BIGINT) + 1"""

CTES["event_points"] = "SELECT game_id, cam, CAST(t_s AS DOUBLE) AS t, MAX(CAST(v AS DOUBLE)) AS v FROM fx_events GROUP BY ALL"
CTES["event_interp"] = """
SELECT g.game_id, g.cam, g.idx,
  round_even((CASE WHEN a.t IS NULL THEN b.v WHEN b.t IS NULL THEN a.v ELSE a.v + (b.v - a.v) * ((g.t - a.t) / (b.t - a.t)) END) * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS amount
FROM (SELECT game_id, cam, idx, idx / (1.0::DOUBLE / 600.0::DOUBLE) AS t FROM fx_grid) g
ASOF LEFT JOIN event_points a ON a.game_id = g.game_id AND a.cam = g.cam AND g.t >= a.t
ASOF LEFT JOIN event_points b ON b.game_id = g.game_id AND b.cam = g.cam AND g.t < b.t"""


def _fused_run(v: str, signals: str, frame: str, win: int, segment: int, pct: float, **detector) -> None:
    """All steps of the second detector over another table of signals; `frame` is the smoothing window's extent."""
    CTES[f"flow{v}"] = f"SELECT *, 0.7::DOUBLE * net + 0.3::DOUBLE * slot AS flow FROM {signals}"
    CTES[f"flow_scale{v}"] = f"SELECT game_id, cam, quantile_cont(flow, 0.99) AS pf, quantile_cont(audio, 0.99) AS pa FROM flow{v} GROUP BY ALL"
    CTES[f"smoothed{v}"] = f"""
SELECT game_id, cam, idx, round_even((SUM(raw) OVER (PARTITION BY game_id, cam ORDER BY idx ROWS BETWEEN {frame}) / {win}.0) * 1e9, 0) / 1e9 AS smooth FROM (
  SELECT f.*, 0.8::DOUBLE * (flow / (pf + 1e-6)) + 0.2::DOUBLE * (audio / (pa + 1e-6)) AS raw FROM flow{v} f JOIN flow_scale{v} USING (game_id, cam))"""
    CTES[f"series{v}"] = f"""
SELECT game_id, cam, COUNT(*) AS n, quantile_cont(smooth, 0.70) AS floor70, quantile_cont(smooth, 0.99) AS p99 FROM smoothed{v} GROUP BY ALL"""
    CTES[f"attack{v}"] = f"""
SELECT s.*, GREATEST(q, floor70) AS threshold FROM smoothed{v} s JOIN series{v} USING (game_id, cam)
JOIN (SELECT game_id, cam, idx // {segment} AS seg, quantile_cont(smooth, {pct}) AS q FROM smoothed{v} GROUP BY ALL) g ON g.game_id = s.game_id AND g.cam = s.cam AND g.seg = s.idx // {segment}"""
    CTES[f"runs{v}"] = _RUNS.format(keys="game_id, cam", table=f"smoothed{v}")
    CTES[f"tops{v}"] = _TOPS.format(keys="game_id, cam", table=f"runs{v}")
    _detector(v, f"attack{v} a ON a.game_id = t.game_id AND a.cam = t.cam AND a.idx = t.idx JOIN series{v} s ON s.game_id = t.game_id AND s.cam = t.cam", f"smoothed{v}", **detector)


CTES["motion_rois"] = """
SELECT game_id, cam, idx, AVG(m) FILTER (x BETWEEN 2 AND 4 AND y BETWEEN 2 AND 4) AS net,
  AVG(m) FILTER (x BETWEEN 5 AND 7 AND y BETWEEN 5 AND 7) AS slot FROM grid_pixels GROUP BY ALL"""
CTES["energy_rois"] = """
SELECT p.game_id, p.cam, p.idx, SUM(CASE WHEN x BETWEEN 2 AND 4 AND y BETWEEN 2 AND 4 THEN d ELSE 0 END) AS net,
  SUM(CASE WHEN x BETWEEN 5 AND 7 AND y BETWEEN 5 AND 7 THEN d ELSE 0 END) AS slot, SUM(d) AS "full" FROM pixels p GROUP BY ALL"""
CTES["extracted"] = """
SELECT m.game_id, m.cam, m.idx, m.net, m.slot, COALESCE(CASE WHEN b.t IS NULL THEN a.rms WHEN a.t IS NULL THEN b.rms
  ELSE a.rms + (b.rms - a.rms) * ((m.idx / 4.0 - a.t) / (b.t - a.t)) END, 0.0) AS audio
FROM motion_rois m LEFT JOIN rms a ON a.game_id = m.game_id AND a.cam = m.cam AND a.k = LEAST(CAST(FLOOR(m.idx / 4.0 / 0.5 - 0.5) AS BIGINT), (SELECT MAX(k) FROM rms))
LEFT JOIN rms b ON b.game_id = m.game_id AND b.cam = m.cam AND b.k = CAST(FLOOR(m.idx / 4.0 / 0.5 - 0.5) AS BIGINT) + 1"""
_fused_run("3", "extracted", "1 PRECEDING AND CURRENT ROW", 2, 1200, 0.95)
_fused_run("5", "fx_signals", "3 PRECEDING AND 2 FOLLOWING", 6, 3600, 0.92, fps=12, distance=72, gap=2.0, drop=24, near=8, longest=25.0, cooldown=0.0)
CTES["one_camera"] = "SELECT * FROM fx_signals WHERE cam = 1 OR game_id % 2 = 0"
_fused_run("6", "one_camera", "1 PRECEDING AND CURRENT ROW", 2, 1200, 0.95)
CTES["smoothed4"] = """
SELECT game_id, cam, idx, round_even((SUM(0.7::DOUBLE * net + 0.3::DOUBLE * slot) OVER (PARTITION BY game_id, cam ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2.0) * 1e9, 0) / 1e9 AS smooth
FROM energy_rois"""
CTES["series4"] = """
SELECT game_id, cam, COUNT(*) AS n, quantile_cont(smooth, 0.95) AS threshold, quantile_cont(smooth, 0.99) AS p99 FROM smoothed4 GROUP BY ALL"""
CTES["runs4"] = _RUNS.format(keys="game_id, cam", table="smoothed4")
CTES["tops4"] = _TOPS.format(keys="game_id, cam", table="runs4")
_detector("4", "series4 s ON s.game_id = t.game_id AND s.cam = t.cam", "smoothed4")

SELECTS: dict[str, str] = {
    # Sources and sinks
    "read_rois": "SELECT * FROM fx_rois",
    "clamp_rois": """SELECT game_id, cam, roi, cx AS x, cy AS y, GREATEST(1, LEAST(w, 1920 - cx)) AS w, GREATEST(1, LEAST(h, 1080 - cy)) AS h
        FROM (SELECT *, GREATEST(0, LEAST(x, 1919)) AS cx, GREATEST(0, LEAST(y, 1079)) AS cy FROM fx_rois)""",
    "rects_from_corners": """SELECT l_orderkey, l_linenumber, LEAST(a, c) AS x, LEAST(b, d) AS y, ABS(c - a) AS w, ABS(d - b) AS h FROM (
        SELECT *, GREATEST(0, LEAST(x1, 1919)) AS a, GREATEST(0, LEAST(y1, 1079)) AS b, GREATEST(0, LEAST(x2, 1919)) AS c, GREATEST(0, LEAST(y2, 1079)) AS d FROM fx_corners)
        WHERE ABS(c - a) > 3 AND ABS(d - b) > 3""",
    "complete_rois": """SELECT game_id FROM (SELECT game_id, cam, CASE WHEN w % 10 = 3 THEN 'bench' ELSE roi END AS roi FROM fx_rois)
        WHERE roi IN ('net', 'slot') GROUP BY 1 HAVING COUNT(DISTINCT (cam, roi)) = 4""",
    "pair_sources": """SELECT folder, cam1, cam2 FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder,
        MIN(path) FILTER (path LIKE '%cam1%.mp4') AS cam1, MIN(path) FILTER (path LIKE '%cam2%.mp4') AS cam2 FROM fx_paths GROUP BY 1)
        WHERE cam1 IS NOT NULL AND cam2 IS NOT NULL""",
    "sample_to_grid": "SELECT * FROM fx_signals",
    "read_markers": """SELECT * FROM (SELECT game_id, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY seq) AS pos, "Frame", "Name", "Note", "Color", "Duration"
        FROM fx_markers_raw WHERE TRY_CAST("Frame" AS DOUBLE) IS NOT NULL)""",
    "write_events": "SELECT game_id, pos, line FROM event_lines",
    "write_markers": """SELECT game_id, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY seq) AS pos, frame AS "Frame", name AS "Name", note AS "Note",
        color AS "Color", duration AS "Duration" FROM play_replay""",
    "fcpxml_lines": _XML,
    "edl_lines": _EDL,
    # Extraction and conditioning
    "prev_frame_pairs": "SELECT game_id, cam, idx, list_sum(cur) AS cur_sum, list_sum(prev) AS prev_sum, cur[1] AS cur_first, prev[64] AS prev_last FROM pixel_pairs",
    "framediff_energy": "SELECT * FROM energy_rois",
    "framediff_energy_bytes": "SELECT * FROM energy_rois",
    "roi_mean_motion": "SELECT * FROM motion_rois",
    "audio_rms": "SELECT * FROM rms",
    "interp_to_grid": "SELECT * FROM audio_interp",
    "interp_to_grid_events": "SELECT * FROM event_interp",
    "audio_or_zeros": """SELECT s.game_id, s.cam, s.idx, s.net, s.slot, COALESCE(a.rms, 0) AS audio FROM fx_signals s
        LEFT JOIN audio_interp a ON a.game_id = s.game_id AND a.cam = s.cam AND a.idx = s.idx""",
    "blend_rois": "SELECT game_id, cam, idx, flow FROM flow",
    "normalize_p99": "SELECT game_id, cam, idx, flow / (pf + 1e-6) AS flow_norm FROM flow JOIN flow_scale USING (game_id, cam)",
    "fuse_signals": "SELECT game_id, cam, idx, raw FROM fused",
    "moving_average": "SELECT game_id, cam, idx, smooth FROM smoothed",
    "rolling_threshold": "SELECT game_id, cam, idx, threshold FROM attack",
    "global_threshold": "SELECT game_id, cam, idx, threshold FROM smoothed1 JOIN series1 USING (game_id, cam)",
    # Peaks, windows, scoring
    "local_maxima": 'SELECT game_id, cam, idx, "left", "right", value FROM tops',
    "peaks_above": "SELECT t.game_id, t.cam, t.idx, t.value FROM tops t JOIN attack a ON a.game_id = t.game_id AND a.cam = t.cam AND a.idx = t.idx WHERE t.value >= threshold",
    "suppress_by_distance": "SELECT game_id, cam, idx, peak_val AS value FROM peaks2",
    "peak_windows": "SELECT * FROM peaks2",
    "union_cameras": "SELECT game_id, cam, start_s, end_s FROM peaks2",
    "merge_intervals": "SELECT * FROM merged2",
    "sanitize_windows": "SELECT * FROM clean2",
    "window_samples": "SELECT game_id, window_id, cam, idx, smooth FROM slices2",
    "window_max": "SELECT game_id, window_id, cam, n, m AS max_attack, argmax FROM maxima2",
    "window_rebound": "SELECT game_id, window_id, cam, rebound FROM rebounds2",
    "window_drop": 'SELECT game_id, window_id, cam, drop_v AS "drop" FROM drops2',
    "choose_camera": "SELECT game_id, window_id, m1, m2, primary_cam, conf FROM chosen2",
    "score_windows": "SELECT game_id, window_id, score FROM scored2",
    "series_p99": "SELECT game_id, cam, p99 FROM series",
    "color_class": "SELECT game_id, window_id, color, CASE color WHEN 'Red' THEN 3 WHEN 'Orange' THEN 2 WHEN 'Yellow' THEN 1 ELSE 0 END AS rank FROM scored2",
    "cap_duration": "SELECT game_id, window_id, start_s, end_s, color FROM capped2",
    "cooldown": "SELECT game_id, window_id, start_s, end_s, score FROM final2",
    "to_markers": "SELECT game_id, seq, frame, name, note, color, duration FROM plays",
    "replay_markers": "SELECT * FROM play_replay",
    "detection_summary": """SELECT g.game_id, (SELECT COUNT(*) FROM peaks2 p WHERE p.game_id = g.game_id AND cam = 1) AS peaks_cam1,
        (SELECT COUNT(*) FROM peaks2 p WHERE p.game_id = g.game_id AND cam = 2) AS peaks_cam2, (SELECT COUNT(*) FROM merged2 p WHERE p.game_id = g.game_id) AS windows,
        (SELECT COUNT(*) FROM capped2 p WHERE p.game_id = g.game_id) AS events_before_cooldown, (SELECT COUNT(*) FROM final2 p WHERE p.game_id = g.game_id) AS events_after_cooldown,
        (SELECT COUNT(*) FROM play_replay p WHERE p.game_id = g.game_id) AS markers FROM (SELECT DISTINCT game_id FROM peaks2) g""",
    "debug_series": """SELECT a.game_id, a.cam, a.idx, a.idx / 4.0 AS t_s, a.smooth AS signal, a.threshold, p.idx IS NOT NULL AS is_peak
        FROM attack a LEFT JOIN peaks2 p ON p.game_id = a.game_id AND p.cam = a.cam AND p.idx = a.idx""",
    "rank_events": """SELECT game_id, window_id, score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY score DESC, start_s) AS rank FROM final2) WHERE rank <= 5""",
    # Marker tables
    "tc_to_frames": f"""SELECT game_id, event_no, in_frame + 216000 AS frames FROM edl_events""",
    "frames_to_tc": f"SELECT game_id, event_no, {_TC.format(n='in_frame')} AS tc FROM edl_events",
    "parse_win_seconds": "SELECT game_id, seq, win AS win_s FROM raw_typed",
    "parse_color": r"""SELECT game_id, seq, CONCAT(UPPER(LEFT(word, 1)), LOWER(SUBSTRING(word, 2))) AS color FROM (SELECT *, COALESCE(NULLIF(regexp_extract("Name", '\[([A-Za-z]+)\]', 1), ''),
        NULLIF(regexp_extract("Note", '\[([A-Za-z]+)\]', 1), ''), 'Blue') AS word FROM fx_markers_raw)""",
    "parse_cam_angle": r"""SELECT game_id, seq, COALESCE(TRY_CAST(NULLIF(regexp_extract("Name", '(?i)\bcam([0-9]+)\b', 1), '') AS INT), TRY_CAST(NULLIF(regexp_extract("Note", '(?i)\bcam([0-9]+)\b', 1), '') AS INT), 1) - 1 AS angle
        FROM fx_markers_raw""",
    "normalize_markers": "SELECT * FROM fx_markers",
    "to_edl_events": "SELECT * FROM edl_events",
    "marker_label": """SELECT game_id, seq, CASE WHEN LENGTH(label) > 120 THEN CONCAT(LEFT(label, 117), '...') ELSE label END AS label FROM (
        SELECT game_id, seq, TRIM(CONCAT_WS(' ', CASE WHEN color <> '' THEN CONCAT('[', color, ']') END, NULLIF(name, ''), NULLIF(CONCAT(REPLACE(note, chr(10), ' '), REPEAT('+', CAST(seq % 120 AS INT))), ''))) AS label FROM raw_typed)""",
    "rational_time": f"SELECT game_id, seq, {_RATIONAL.format(n='frame')} AS start, {_RATIONAL.format(n='duration')} AS length FROM fx_markers",
    "xml_escape": f"SELECT game_id, seq, {_ESCAPED.format(c='note')} AS escaped FROM fx_markers",
    "tag_note": "SELECT game_id, seq, CASE WHEN note = '' THEN CONCAT('[', color, ']') ELSE CONCAT('[', color, '] ', note) END AS note FROM fx_markers",
    "expand_markers": "SELECT * FROM ranges",
    "expansion_counts": """SELECT m.game_id, COUNT(r.seq) AS expanded, COUNT(*) - COUNT(r.seq) AS skipped FROM fx_markers m
        LEFT JOIN ranges r ON r.game_id = m.game_id AND r.seq = m.seq GROUP BY m.game_id""",
    "split_points": "SELECT * FROM cuts",
    "split_clips": "SELECT * FROM pieces",
    "assign_angles": """SELECT c.game_id, c.clip_id, c.start_frame, c.end_frame, COALESCE(arg_min(r.angle, (r.start_frame, r.seq)), (c.clip_id % 3 + 3) % 3 + 4) AS angle
        FROM (SELECT *, 1 AS copy FROM fx_clips UNION ALL SELECT *, 2 FROM fx_clips WHERE clip_id % 5 = 0) c
        LEFT JOIN ranges r ON r.game_id = c.game_id AND r.start_frame <= (c.start_frame + c.end_frame) / 2.0 AND (c.start_frame + c.end_frame) / 2.0 < r.end_frame GROUP BY c.game_id, c.clip_id, c.start_frame, c.end_frame, c.copy""",
    "merge_markers": "SELECT game_id, frame, color, name, note, duration FROM merge_dst UNION ALL SELECT * FROM merge_new",
    "merge_counts": """SELECT s.game_id, COALESCE(n.c, 0) AS copied, s.c - COALESCE(n.c, 0) AS skipped FROM (SELECT game_id, COUNT(*) AS c FROM count_src GROUP BY 1) s
        LEFT JOIN (SELECT game_id, COUNT(*) AS c FROM count_new GROUP BY 1) n USING (game_id)""",
    "replace_markers": """SELECT game_id, frame, color, name, note, duration FROM merge_dst WHERE game_id NOT IN (SELECT game_id FROM merge_src)
        UNION ALL SELECT DISTINCT game_id, frame, color, name, note, duration FROM merge_src""",
    # Composites
    "detect_v1": "SELECT * FROM final1",
    "detect_v2": "SELECT * FROM final2",
    "detect_v2_defaults": "SELECT * FROM final5",
    "detect_v2_one_camera": "SELECT * FROM final6",
    "extract_signals": "SELECT * FROM extracted",
    "detect_from_motion": "SELECT * FROM final3",
    "detect_from_frames": "SELECT * FROM final4",
    "merge_markers_all": "SELECT game_id, frame, color, name, note, duration FROM merge_dst UNION ALL SELECT game_id, frame, color, name, note, duration FROM merge_src",
    "markers_v2": "SELECT * FROM play_replay",
    "conform_timeline": """SELECT c.game_id, c.clip_id, c.start_frame, c.end_frame, COALESCE(arg_min(r.angle, (r.start_frame, r.seq)), (c.clip_id % 3 + 3) % 3 + 4) AS angle FROM pieces c
        LEFT JOIN ranges r ON r.game_id = c.game_id AND r.start_frame <= (c.start_frame + c.end_frame) / 2.0 AND (c.start_frame + c.end_frame) / 2.0 < r.end_frame GROUP BY c.game_id, c.clip_id, c.start_frame, c.end_frame""",
}

# The published lines of the batch run, from the final events and the markers as they are written.
CTES["batch_raw"] = """
SELECT game_id, seq, CAST(frame AS VARCHAR) AS "Frame", name AS "Name", note AS "Note", color AS "Color", CAST(duration AS VARCHAR) AS "Duration" FROM play_replay"""
CTES["batch_typed"] = _TYPED.format(table="batch_raw")
CTES["batch_edl"] = _EDL_EVENTS.format(table="batch_typed")
CTES["batch_games"] = "SELECT DISTINCT game_id FROM fx_events UNION SELECT -1"
SELECTS["run_game_batch"] = f"""
SELECT game_id, 'events' AS kind, pos, line FROM event_lines
UNION ALL SELECT game_id, 'events', 0, 'start_s,end_s,score,primary_cam,confidence' FROM batch_games
UNION ALL SELECT game_id, 'markers', ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY seq), CONCAT_WS(',', frame, name, note, color, duration) FROM play_replay
UNION ALL SELECT game_id, 'markers', 0, 'Frame,Name,Note,Color,Duration' FROM batch_games
UNION ALL SELECT game_id, 'fcpxml', line_no, line FROM ({_XML.replace("fx_markers", "play_replay")})
UNION ALL SELECT game_id, 'edl', line_no, line FROM ({_EDL.replace("SELECT DISTINCT game_id FROM edl_events", "SELECT game_id FROM batch_games").replace("edl_events", "batch_edl")})"""

_CASTS = {"i": "CAST({c} AS BIGINT)", "f": "ROUND(CAST({c} AS DOUBLE), 6) + 0.0", "g": "ROUND(CAST({c} AS DOUBLE), 9) + 0.0", "s": "CAST({c} AS VARCHAR)", "b": "CAST({c} AS BOOLEAN)"}


def sql(name: str, columns: str) -> str:
    """The query with the shared steps it needs and its columns cast to the declared kinds."""
    body = SELECTS[name]
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in CTES and word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(body)
    steps = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" if not _recursive(n) else f"{n} AS ({CTES[n].strip()})"
                       for n in CTES if n in needed)
    out = ", ".join(_CASTS[kind].format(c=f'"{c}"') + f' AS "{c}"' for c, kind in (x.split(":") for x in columns.split()))
    return (f"WITH RECURSIVE {steps}\n" if steps else "") + f"SELECT {out} FROM ({body.strip()}) AS result"


def _recursive(name: str) -> bool:
    return re.search(rf"\bFROM {name} g\b", CTES[name]) is not None

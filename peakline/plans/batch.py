"""The production run: detect, then publish every table of every game."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakline.config import DetectConfig
from peakline.functions.text import strip
from peakline.operators import markers as M
from peakline.operators.cut import cut
from peakline.plans.detect import markers_of, run_detection
from peakline.sources.publish import publish
from peakline.sources.tables import EVENT_HEADER, MARKER_HEADER, event_lines, marker_lines

KINDS = ["events", "markers", "fcpxml", "edl"]
HEADERS = {"events": ",".join(EVENT_HEADER), "markers": ",".join(MARKER_HEADER)}


def as_written(markers: DataFrame) -> DataFrame:
    """Raw marker rows as a reader of the marker table would get them."""
    return markers.select("game_id", "seq", *[strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c.capitalize()) for c in ("frame", "name", "note", "color", "duration")])


def batch_lines(scored: DataFrame, games: DataFrame, cfg: DetectConfig, project: str = M.XML_PROJECT) -> DataFrame:
    """(kind, game_id, major, minor, line) of all documents of all games.

    The interchange files are made from the rows of the marker table, as a user would make them later.
    A game without events gets tables and a cut list that hold their header only, and no FCPXML.
    """
    markers = cut(markers_of(scored, cfg))
    xml, edl = M.documents(as_written(markers), cfg.timeline_fps, project, games)
    numbered = lambda lines: lines.select("game_id", F.col("line_no").cast("double").alias("major"), F.lit(0.0).alias("minor"), "line")
    parts = {"events": event_lines(scored), "markers": marker_lines(markers), "fcpxml": numbered(xml), "edl": numbered(edl)}
    empty = F.explode(F.array(*[F.lit(kind) for kind in HEADERS])).alias("kind")
    rows = games.select(empty, "game_id", F.lit(float("-inf")).alias("major"), F.lit(0.0).alias("minor"), F.lit(None).cast("string").alias("line"))
    for kind, lines in parts.items():
        rows = rows.unionByName(lines.withColumn("kind", F.lit(kind)))
    return rows


def run_game_batch(spark: SparkSession, signals: DataFrame, out: str, cfg: DetectConfig | None = None,
                   project: str = M.XML_PROJECT) -> dict[str, str]:
    """Publishes events, markers, FCPXML and cut lists below `out`, all by one job; returns the folder of each.

    `published` finds the folders of the last run that came to its end.
    """
    cfg = cfg or DetectConfig.live()
    games = cut(signals.select("game_id").distinct())
    return publish(batch_lines(run_detection(signals, cfg, 2).scored, games, cfg, project), out, HEADERS, KINDS)

"""Reading and writing marker tables, event tables and interchange text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakline.functions.text import fixed, strip
from peakline.operators.chunks import stated_tasks
from peakline.sources.records import fields, quoted_records

MARKER_HEADER = ["Frame", "Name", "Note", "Color", "Duration"]
#: Bits of a row's place in its file; files are smaller than 2^40 bytes.
FILE_BITS = 40
EVENT_HEADER = ["start_s", "end_s", "score", "primary_cam", "confidence"]


def read_markers(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Raw marker rows (game_id, seq, Frame, Name, Note, Color, Duration), all text, trimmed.

    Games are `game_id=...` folders. `seq` follows the row order of a game: its files by path, then the
    rows of each. Quoted fields may hold line breaks; a file of any size is still read by many tasks.
    """
    # Only for its columns: one record is read. All files must have its header.
    table = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True)
    games = "game_id" in table.columns
    header = [c.strip() for c in table.columns if c != "game_id" or not games]
    missing = [c for c in MARKER_HEADER if c not in header]
    if missing:
        raise ValueError(f"marker table lacks columns {missing}; found {sorted(header)}")
    rows = fields(quoted_records(spark, path, sep), len(header), sep, names=header)
    # One row per file; the window numbers the files of a game.
    folder = F.regexp_extract(F.url_decode("file"), r"/game_id=([^/]*)/", 1)
    game = folder.cast(table.schema["game_id"].dataType) if games else F.lit(0)
    number = F.row_number().over(Window.partitionBy("game_id").orderBy("file")).cast("long")
    files = rows.select("file").distinct().withColumn("game_id", game).withColumn("_no", number)
    texts = [strip(F.coalesce(F.col("fields")[header.index(c)], F.lit(""))).alias(c) for c in MARKER_HEADER]
    return (rows.join(files, "file")
            .select("game_id", (F.shiftleft(F.col("_no") - 1, FILE_BITS) + F.col("pos")).alias("seq"), *texts)
            .filter(F.col("Frame").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")))


def _write_ordered(df: DataFrame, order: list, drop: list[str], fmt: str, path: str, **options) -> None:
    """One folder per game; its part files, by number, hold the rows in order.

    Range partitioning on the whole order spreads a large game over several files and tasks. The number of tasks is stated: most
    of the work is opening files, which adaptive plans would gather in one task for their few bytes.
    """
    (df.repartitionByRange(stated_tasks(df), "game_id", *order).sortWithinPartitions("game_id", *order).drop(*drop)
     .write.mode("overwrite").partitionBy("game_id").format(fmt).options(**options).save(path))


def write_markers(markers: DataFrame, path: str) -> None:
    """CSV with header, rows in emission order (a REPLAY right after its PLAY)."""
    rows = markers.select("game_id", "seq", F.col("frame").alias("Frame"), F.col("name").alias("Name"),
                          F.col("note").alias("Note"), F.col("color").alias("Color"), F.col("duration").alias("Duration"))
    _write_ordered(rows, ["seq"], ["seq"], "csv", path, header=True, quote='"', escape='"', emptyValue="")


def write_events(scored: DataFrame, path: str) -> None:
    """CSV of all scored windows, best first within a game."""
    rows = scored.select("game_id", *_event_fields(), (-F.col("score")).alias("_best"), F.col("start_s").alias("_start"))
    _write_ordered(rows, ["_best", "_start"], ["_best", "_start"], "csv", path, header=True)


def _event_fields() -> list[Column]:
    return [fixed(F.col("start_s"), 3).alias("start_s"), fixed(F.col("end_s"), 3).alias("end_s"),
            fixed(F.col("score"), 4).alias("score"), F.col("primary_cam"), fixed(F.col("conf"), 4).alias("confidence")]


def event_lines(scored: DataFrame) -> DataFrame:
    """(game_id, major, minor, line) of the event table, in the order of `write_events`."""
    return scored.select("game_id", (-F.col("score")).alias("major"), F.col("start_s").alias("minor"), F.to_csv(F.struct(*_event_fields())).alias("line"))


def marker_lines(markers: DataFrame) -> DataFrame:
    """(game_id, major, minor, line) of the marker table, in the order of `write_markers`."""
    row = F.to_csv(F.struct("frame", "name", "note", "color", "duration"), {"quote": '"', "escape": '"', "emptyValue": ""})
    return markers.select("game_id", F.col("seq").cast("double").alias("major"), F.lit(0.0).alias("minor"), row.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text documents, one folder per game."""
    _write_ordered(lines, ["line_no"], ["line_no"], "text", path)


def write_fcpxml(lines: DataFrame, path: str) -> None:
    """As `write_lines`; a document without markers is an error."""
    if lines.isEmpty():
        raise ValueError("no markers to write")
    write_lines(lines, path)

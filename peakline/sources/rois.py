"""Rectangles of interest and recording paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakline.operators.extract import clamp_rect

_CAMERA = "struct<net: array<double>, slot: array<double>>"


def read_rois(spark: SparkSession, path: str, multi_line: bool = True, strict: bool = True) -> DataFrame:
    """One row per (game, cam, roi) from nested JSON.

    The game comes from a `game_id=...` folder (one document per game) or from a `game_id` field
    (`multi_line=False`: one document per line, which Spark can split). A rectangle that does not
    have four numbers is an error; a missing one too unless `strict` is off.
    """
    probe = f"game_id string, camera_1 {_CAMERA}, camera_2 {_CAMERA}"
    docs = spark.read.schema(probe).json(path, multiLine=multi_line)

    def rect(cam: int, roi: str) -> Column:
        numbers = F.col(f"camera_{cam}.{roi}")
        return F.struct(F.lit(cam).alias("cam"), F.lit(roi).alias("roi"), numbers.alias("r"))

    rows = docs.select("game_id", F.explode(F.array(*[rect(c, r) for c in (1, 2) for r in ("net", "slot")])).alias("_e"))
    rows = rows.select("game_id", "_e.*")
    if not strict:
        rows = rows.filter(F.col("r").isNotNull())
    bad = F.coalesce(F.size("r"), F.lit(-1)) != 4
    message = F.concat(F.lit("rectangle needs 4 numbers: game "), F.coalesce("game_id", F.lit("?")),
                       F.lit(" camera "), F.col("cam").cast("string"), F.lit(" "), F.col("roi"))
    checked = F.when(bad, F.raise_error(message).cast("array<double>")).otherwise(F.col("r"))
    rows = rows.withColumn("r", checked)
    return rows.select("game_id", "cam", "roi", *[F.col("r")[i].cast("int").alias(c) for i, c in enumerate("xywh")])


def clamp_rois(rois: DataFrame, width: int, height: int) -> DataFrame:
    """Move and shrink rectangles into the picture."""
    rect = clamp_rect(F.struct("x", "y", "w", "h"), F.lit(width), F.lit(height))
    rest = [c for c in rois.columns if c not in "xywh"]
    return rois.select(*rest, rect.alias("_r")).select(*rest, "_r.*")


def rects_from_corners(corners: DataFrame, width: int, height: int) -> DataFrame:
    """Rectangles from two dragged corners; both sides must exceed three pixels."""
    def inside(c: str, size: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(c), F.lit(size - 1)))

    x1, x2, y1, y2 = inside("x1", width), inside("x2", width), inside("y1", height), inside("y2", height)
    rest = [c for c in corners.columns if c not in ("x1", "y1", "x2", "y2")]
    return (corners.select(*rest, F.least(x1, x2).alias("x"), F.least(y1, y2).alias("y"),
                           F.abs(x2 - x1).alias("w"), F.abs(y2 - y1).alias("h"))
            .filter((F.col("w") > 3) & (F.col("h") > 3)))


def complete_rois(rois: DataFrame) -> DataFrame:
    """Games that have the net and the slot of both cameras."""
    def present(cam: int, roi: str) -> Column:
        return F.max(F.when((F.col("cam") == cam) & (F.col("roi") == roi), 1).otherwise(0))

    found = sum((present(c, r) for c in (1, 2) for r in ("net", "slot")), F.lit(0))
    return rois.groupBy("game_id").agg(found.alias("_found")).filter(F.col("_found") == 4).select("game_id")


def pair_sources(paths: DataFrame) -> DataFrame:
    """First recording of each camera per folder; folders without both are dropped."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    file = F.regexp_extract("path", r"([^/]*)$", 1)

    def first(cam: int) -> Column:
        wanted = file.like(f"%cam{cam}%.mp4") & ~file.startswith(".")
        return F.min(F.when(wanted, F.col("path"))).alias(f"cam{cam}")

    return (paths.groupBy(folder.alias("folder")).agg(first(1), first(2))
            .filter(F.col("cam1").isNotNull() & F.col("cam2").isNotNull()))

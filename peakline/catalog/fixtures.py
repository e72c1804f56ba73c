"""Deterministic views over the driver tables that give every operator an input.

All of them grow with the tables: games are blocks of users, so more users mean more games.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakline.config import DetectConfig
from peakline.operators.cut import cut
from peakline.operators.extract import sample_to_grid
from peakline.operators.markers import normalize_markers

USERS_PER_GAME = 38
BIN_S = 600
CFG = DetectConfig.live(fps=4, audio_weight=0.2)
CLIP_FRAMES = 5000
RATE = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _game(user):
    return F.floor(user / F.lit(USERS_PER_GAME)).cast("int")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (game, cam, whole seconds since the start, decimals per kind of event)."""
    e = table(spark, sf_dir, "events")
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", origin, F.col("ts"))
    amount = F.col("value").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")

    def of(*kinds: str):
        return F.when(F.col("event_type").isin(*kinds), amount).otherwise(zero)

    return e.select(_game(F.col("user_id")).alias("game_id"), (F.col("event_id") % 2 + 1).cast("int").alias("cam"),
                    seconds.alias("t_s"), of("click", "purchase").alias("net"), of("view", "signup").alias("slot"),
                    of("error").alias("audio"))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = timed_events(spark, sf_dir)
    last = timed.agg(F.max(F.floor(F.col("t_s") / BIN_S))).first()[0]
    return sample_to_grid(timed, 1.0 / BIN_S, values=["net", "slot", "audio"], n_samples=0 if last is None else last + 1)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a point at its own second, the amounts as values."""
    amount = sum((F.col(c) for c in ("slot", "audio")), F.col("net")).cast("double")
    return timed_events(spark, sf_dir).select("game_id", "cam", "t_s", amount.alias("amount"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cameras per game, ten-minute bins taken as samples, as many as the whole table needs."""
    return cut(event_grid(spark, sf_dir).select("game_id", "cam", "idx", *[F.col(c).cast("double").alias(c) for c in ("net", "slot", "audio")]))


def markers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unparsed marker rows: bad and fractional frames, missing notes and colours, bad lengths."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    number = (i * 37 % 100000).cast("string")
    return e.select(
        _game(F.col("user_id")).alias("game_id"), i.alias("seq"),
        F.when(i % 50 == 0, "bad").when(i % 1013 == 7, "99999999999999999999").when(i % 7 == 0, F.concat(number, F.lit(".9"))).otherwise(number).alias("Frame"),
        F.when(F.col("event_type") == "error", "replay").when(i % 997 == 5, "PLAY cam3000000000")
        .otherwise(F.concat(F.lit("PLAY cam"), (F.col("user_id") % 2 + 1).cast("string"))).alias("Name"),
        F.when(i % 11 == 0, "").when(i % 13 == 0, '[red] & "x" <y>')
        .when(i % 991 == 3, "win=900000000s").when(i % 983 == 4, "win=1e9s win=300000000000000000s").when(i % 977 == 6, 'line "one"\nline two win=3.0s')
        .otherwise(F.concat(F.lit("score=1.20 conf=0.40 win="), (i % 30).cast("string"), F.lit("."), (i % 10).cast("string"), F.lit("s"))).alias("Note"),
        F.when(i % 5 == 0, "").when(i % 5 == 1, "Blue").when(i % 5 == 2, "Yellow").when(i % 5 == 3, "Orange").otherwise("Red").alias("Color"),
        F.when(i % 9 == 0, "n/a").otherwise((i % 1500).cast("string")).alias("Duration"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed markers, as a stored table would hold them; several steps of a query read it."""
    return cut(normalize_markers(markers_raw(spark, sf_dir).repartition("game_id", "seq"), CFG.timeline_fps))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording paths per user; some folders lack a camera and camera 3 is noise."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("/games/"), F.col("user_id").cast("string"), F.lit("/g"), F.col("event_id").cast("string"),
                             F.lit("_cam"), (F.col("event_id") % 3 + 1).cast("string"), F.lit(".mp4")).alias("path"))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as samples of one recording: a single series that holds every row."""
    e = table(spark, sf_dir, "events")
    amp = F.floor(F.col("value").cast("decimal(18,2)") * 100).cast("int") - 5000
    # The keys come from a column: the optimizer would fold constants and drop the equi-joins on them.
    game = F.floor(F.col("user_id") / 10 ** 9).cast("int")
    return e.select(game.alias("game_id"), (game + 1).alias("cam"), F.col("event_id").alias("sample_idx"), amp.alias("amp"))


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    ln = table(spark, sf_dir, "lineitem")
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    return ln.select("l_orderkey", "l_linenumber",
                     (F.col("l_partkey") % 2200 - 100).cast("int").alias("x1"), (F.col("l_suppkey") * 13 % 1300 - 50).cast("int").alias("y1"),
                     (order * 7 % 2200 - 100).cast("int").alias("x2"), ((order * 97 + line) % 1300 - 50).cast("int").alias("y2"))


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rectangles per game, many of them outside a 1920 x 1080 picture."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 4).cast("int").alias("game_id"), F.floor(k % 4 / 2 + 1).cast("int").alias("cam"),
        F.when(k % 2 == 0, "net").otherwise("slot").alias("roi"),
        (k * 37 % 2100 - 80).cast("int").alias("x"), (k * 53 % 1200 - 60).cast("int").alias("y"),
        (k * 11 % 900).cast("int").alias("w"), (k * 7 % 700 - 20).cast("int").alias("h"))


def rois_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rectangles; some bear another name, so their games lack one that is needed."""
    return rois(spark, sf_dir).withColumn("roi", F.when(F.col("w") % 10 == 3, F.lit("bench")).otherwise(F.col("roi")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 grey frames of two cameras."""
    pixel = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.5) * 255))).cast("smallint")
    return _frame_keys(spark, sf_dir).select("game_id", "cam", "frame_idx", "width", "height", F.transform("embedding", pixel).alias("pixels"))


def byte_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames with one byte per pixel, as decoders give them."""
    return frames(spark, sf_dir).withColumn("pixels", F.unhex(F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(p), 2, "0")), "")))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_keys(spark, sf_dir).select("game_id", "cam", "frame_idx", "width", "height",
                                             F.transform("embedding", lambda e: F.abs(e)).alias("mag"))


def _frame_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.lit(0).alias("game_id"), (v % 2 + 1).cast("int").alias("cam"), F.floor(v / 2).cast("long").alias("frame_idx"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), "embedding")


def frame_rois(frames: DataFrame, zoom: int = 1) -> DataFrame:
    """A net and a slot per camera, on a picture `zoom` times as large; the slot reaches over the picture's edge."""
    def rect(roi, *numbers):
        return F.struct(F.lit(roi).alias("roi"), *[F.lit(n * zoom).alias(c) for c, n in zip("xywh", numbers)])

    both = F.explode(F.array(rect("net", 2, 2, 3, 3), rect("slot", 5, 5, 9, 9)))
    return frames.select("game_id", "cam").distinct().select("game_id", "cam", both.alias("_r")).select("game_id", "cam", "_r.*")


def clips(markers: DataFrame) -> DataFrame:
    """One clip per block of frames that has a marker, each with an angle of its own, and for every game one of 2^50 frames and one of a single frame."""
    block = F.floor(F.col("frame") / CLIP_FRAMES).cast("long")
    blocks = (markers.select("game_id", block.alias("clip_id")).distinct()
              .select("game_id", "clip_id", (F.col("clip_id") * CLIP_FRAMES).alias("start_frame"), ((F.col("clip_id") + 1) * CLIP_FRAMES).alias("end_frame")))
    edge = lambda *values: F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(values, ("clip_id", "start_frame", "end_frame"))])
    odd = markers.select("game_id").distinct().withColumn("_c", F.explode(F.array(edge(-1, 0, 2 ** 50), edge(-2, 40000, 40001)))).select("game_id", "_c.*")
    return blocks.unionByName(odd).withColumn("angle", (F.pmod("clip_id", F.lit(3)) + 4).cast("int"))


def merge_sides(markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source with repeats, of every second game, and a destination that shares some markers with it; every marker is on a side."""
    seq, even = F.col("seq"), F.col("game_id") % 2 == 0
    return (markers.filter(even & (seq % 2 == 0)).unionByName(markers.filter(even & (seq % 10 == 0))),
            markers.filter((seq % 3 == 0) | (seq % 2 == 1) | ~even))


def merge_sides_of_all(markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As `merge_sides`, with a source and a destination in every game; every marker is on a side, a third of the source on both."""
    seq = F.col("seq")
    return markers.filter(seq % 2 == 0).unionByName(markers.filter(seq % 10 == 0)), markers.filter((seq % 3 == 0) | (seq % 2 == 1))

"""From decoded frames, motion grids and audio samples to per-camera signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakline.operators import limits
from peakline.operators.chunks import (
    CHUNK, DEFAULT_CHUNK, FAN_OUT, HOME, SERIES, bucket_prefix, explode_range, floor_div, with_halo)
from peakline.operators.cut import cut
from peakline.operators.kernels import frame_diff_energy
from peakline.operators.workers import shipped

FRAMES_PER_CHUNK = 64


def prev_frame_pairs(frames: DataFrame, frames_per_chunk: int = FRAMES_PER_CHUNK) -> DataFrame:
    """Each frame with its predecessor; the first frame of a series yields no row.

    Frames are the widest rows there are, so they are shuffled once, into short runs of consecutive
    frames, and only the last frame of a run is copied to the next run.
    """
    run = Window.partitionBy(*SERIES, CHUNK).orderBy("frame_idx")
    return (with_halo(frames, frames_per_chunk, before=1, after=0, idx="frame_idx")
            .withColumn("prev_pixels", F.lag("pixels").over(run))
            .filter(F.col(HOME) & F.col("prev_pixels").isNotNull())
            .withColumn("idx", F.col("frame_idx") - F.lit(1).cast("long"))
            .drop(HOME))


def _rect_rows(pixels: Column, width: Column, rect: Column) -> Column:
    """The pixel rows of a rectangle, as an array of arrays."""
    return F.transform(F.sequence(F.lit(0), rect.h - 1),
                       lambda r: F.slice(pixels, (rect.y + r) * width + rect.x + 1, rect.w))


def _abs_diff_sum(cur: Column, prev: Column) -> Column:
    diffs = F.zip_with(cur, prev, lambda a, b: F.abs(a.cast("int") - b.cast("int")).cast("long"))
    return F.aggregate(diffs, F.lit(0).cast("long"), lambda acc, d: acc + d)


def _diff_energy(rect: Column) -> Column:
    rows = F.zip_with(_rect_rows(F.col("pixels"), F.col("width"), rect),
                      _rect_rows(F.col("prev_pixels"), F.col("width"), rect), _abs_diff_sum)
    return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, d: acc + d).cast("double")


def _rects_per_camera(rois: DataFrame) -> DataFrame:
    """One row per (game, cam) with the net and slot rectangles as structs."""
    rect = F.struct("x", "y", "w", "h")
    return rois.groupBy(*SERIES).agg(
        F.first(F.when(F.col("roi") == "net", rect), ignorenulls=True).alias("net_rect"),
        F.first(F.when(F.col("roi") == "slot", rect), ignorenulls=True).alias("slot_rect"))


def clamp_rect(rect: Column, width: Column, height: Column) -> Column:
    x = F.greatest(F.lit(0), F.least(rect.x, width - 1))
    y = F.greatest(F.lit(0), F.least(rect.y, height - 1))
    return F.struct(x.alias("x"), y.alias("y"),
                    F.greatest(F.lit(1), F.least(rect.w, width - x)).alias("w"),
                    F.greatest(F.lit(1), F.least(rect.h, height - y)).alias("h"))


def scale_rois(rois: DataFrame, scale: float = 1.0) -> DataFrame:
    """Rectangles picked on the original picture, rescaled to the analysed one (1.0 leaves them)."""
    if scale == 1.0:
        return rois
    return rois.select(*[(F.col(c) * F.lit(scale)).cast("int").alias(c) if c in "xywh" else F.col(c)
                         for c in rois.columns])


def _with_rects(frames: DataFrame, rects: DataFrame, on: list[str]) -> DataFrame:
    """Attach the rectangles of each camera, clamped to the picture."""
    return (frames.join(rects, on)
            .withColumn("net_rect", clamp_rect(F.col("net_rect"), F.col("width"), F.col("height")))
            .withColumn("slot_rect", clamp_rect(F.col("slot_rect"), F.col("width"), F.col("height"))))


def framediff_energy(frames: DataFrame, rois: DataFrame, frames_per_chunk: int = FRAMES_PER_CHUNK) -> DataFrame:
    """Sum of absolute frame differences in the net, the slot and the whole picture.

    `pixels` is an array of grey values, or BINARY with one byte per pixel (Arrow path).
    """
    # Rectangles are repeated per run of frames and joined on the pairs' own partitioning, so the
    # pixels are not shuffled again. The list of runs comes from a scan of the frame numbers alone.
    runs = frames.select(*SERIES, floor_div(F.col("frame_idx"), frames_per_chunk).alias(CHUNK)).distinct()
    rects = runs.join(_rects_per_camera(rois), SERIES)
    pairs = _with_rects(prev_frame_pairs(frames, frames_per_chunk), rects, [*SERIES, CHUNK])
    if isinstance(frames.schema["pixels"].dataType, T.BinaryType):
        shipped(frames.sparkSession)
        diff_energy = F.pandas_udf(frame_diff_energy, "net double, slot double, full double")
        energy = diff_energy("pixels", "prev_pixels", "width", "height", "net_rect", "slot_rect")
        return pairs.withColumn("_e", energy).select(*SERIES, "idx", "_e.*")
    return pairs.select(*SERIES, "idx", _diff_energy(F.col("net_rect")).alias("net"),
                        _diff_energy(F.col("slot_rect")).alias("slot"),
                        _abs_diff_sum(F.col("pixels"), F.col("prev_pixels")).cast("double").alias("full"))


def roi_mean_motion(motion: DataFrame, rois: DataFrame) -> DataFrame:
    """Mean motion magnitude in the net and slot rectangles; 0 for an empty patch.

    Each grid is cut where it lies: no pixel becomes a row and no grid is grouped. Counted and few, the
    rectangles are broadcast; otherwise they are repeated per run of frames, and no camera's grids meet in one task.
    """
    def mean(rect: Column) -> Column:
        rows = _rect_rows(F.col("mag"), F.col("width"), rect)
        total = F.aggregate(rows, F.lit(0.0), lambda acc, row: acc + F.aggregate(
            row, F.lit(0.0), lambda s, v: s + v.cast("double")))
        count = F.aggregate(rows, F.lit(0), lambda acc, row: acc + F.size(row))
        return F.when(count > 0, total / count).otherwise(F.lit(0.0))

    rects = cut(_rects_per_camera(rois))
    if rects.count() <= limits.FEW_SERIES:
        placed = _with_rects(motion, F.broadcast(rects), SERIES)
    else:
        run = floor_div(F.col("frame_idx"), FRAMES_PER_CHUNK).alias(CHUNK)
        runs = motion.select(*SERIES, run).distinct().join(rects, SERIES)
        placed = _with_rects(motion.select("*", run), runs, [*SERIES, CHUNK])
    return (placed.select(*SERIES, F.col("frame_idx").alias("idx"),
                    mean(F.col("net_rect")).alias("net"), mean(F.col("slot_rect")).alias("slot")))


def audio_rms(audio: DataFrame, rate: int, win_s: float = 0.5) -> DataFrame:
    """Root mean square per window of win_s seconds, stamped at the window centre.

    A trailing partial window is dropped unless it is the only one.
    """
    ws = max(1, int(win_s * rate))
    amp = F.col("amp").cast("double")
    return (audio.groupBy(*SERIES, floor_div(F.col("sample_idx"), ws).alias("k"))
            .agg(F.count(F.lit(1)).alias("_n"), F.sqrt(F.avg(amp * amp)).alias("rms"))
            .filter((F.col("_n") == ws) | (F.col("k") == 0))
            .select(*SERIES, "k", ((F.col("k") + F.lit(0.5)) * F.lit(win_s)).alias("t"), "rms"))


def series_grid(lengths: DataFrame, length: str = "n") -> DataFrame:
    """(keys, idx) for idx in [0, length) of every series."""
    return explode_range(lengths, F.lit(0), F.col(length) - 1, "idx").drop(length)


def interp_to_grid(points: DataFrame, grid: DataFrame, fps: float, value: str = "rms", time: str = "t", bucket_s: float | None = None) -> DataFrame:
    """Linear interpolation of points at idx / fps, clamped outside the points. `grid` holds (keys, idx).

    Points may lie anywhere: with gaps, at irregular times, before the first sample or behind the last. Of points at the same time the
    largest counts; those without a time or a value are left out. A series without points gives nulls.

    Points and samples meet in buckets of `bucket_s` seconds (one chunk of samples, if not given) and look for their neighbours in both
    directions there; what lies beyond a bucket's edge comes from a fold over the buckets, a row each.
    The points are computed once.
    """
    seconds = bucket_s or DEFAULT_CHUNK / fps
    at = F.col("_at")
    point = F.struct(at.alias("t"), F.col(value).cast("double").alias("v"))
    known = cut(points.select(*SERIES, F.col(time).cast("double").alias("_at"), value).filter(at.isNotNull() & ~F.isnan(at) & F.col(value).isNotNull())
                .select(*SERIES, F.floor(at / seconds).cast("long").alias(CHUNK), "_at", point.alias("_point")))
    samples = (grid.select(*SERIES, "idx").withColumn("_at", F.col("idx") / F.lit(fps))
               .select(*SERIES, F.floor(at / seconds).cast("long").alias(CHUNK), "_at", "idx"))
    rows = known.unionByName(samples, allowMissingColumns=True)

    parts = [*SERIES, CHUNK]
    upto = (Window.unboundedPreceding, Window.currentRow)
    # A point at the time of a sample comes before it; seen from behind, the sample comes first.
    ahead = Window.partitionBy(*parts).orderBy("_at", F.col("idx").asc_nulls_first(), "_point").rowsBetween(*upto)
    behind = Window.partitionBy(*parts).orderBy(F.desc("_at"), F.col("idx").desc_nulls_last(), "_point").rowsBetween(*upto)
    near = (rows.withColumn("_low", F.last("_point", ignorenulls=True).over(ahead))
            .withColumn("_high", F.last("_point", ignorenulls=True).over(behind)).filter(F.col("idx").isNotNull()))

    highest = F.struct((-F.col("_point.t")).alias("t"), F.col("_point.v").alias("v"))
    edges = rows.groupBy(*parts).agg(F.max("_point").alias("_last"), F.max(F.when(F.col("_point").isNotNull(), highest)).alias("_first"))
    edges = edges.withColumn("_first", F.when(F.col("_first").isNotNull(), F.struct((-F.col("_first.t")).alias("t"), F.col("_first.v").alias("v"))))
    edges = cut(edges)
    before = bucket_prefix(edges, SERIES, CHUNK, "_last", "last", "_before").select(*parts, "_before")
    after = bucket_prefix(edges, SERIES, CHUNK, "_first", "last", "_after", backwards=True).select(*parts, "_after")
    low, high = F.coalesce("_low", "_before"), F.coalesce("_high", "_after")
    between = low.v + (high.v - low.v) * ((at - low.t) / (high.t - low.t))
    return (near.join(before, parts, "left").join(after, parts, "left")
            .select(*SERIES, "idx", F.coalesce(between, low.v, high.v).alias(value)))


def audio_or_zeros(signals: DataFrame, audio: DataFrame, value: str = "rms") -> DataFrame:
    """Add the audio column; samples without audio get 0."""
    return (signals.drop("audio").join(audio.select(*SERIES, "idx", F.col(value).alias("audio")), [*SERIES, "idx"], "left")
            .withColumn("audio", F.coalesce(F.col("audio"), F.lit(0.0))))


def sample_to_grid(df: DataFrame, fps: float, keys: list[str] = SERIES, time_s: str = "t_s",
                   values: list[str] = ("value",), n_samples: int | None = None, origin_s: float = 0.0, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Time-stamped rows onto a dense 1/fps grid: summed per bin, gaps filled with 0.

    Sample 0 begins at `origin_s`; a row before it is an error. Rows without a
    time have no place and are left out. Without `n_samples` each series ends with its own last bin; with it
    the grid is that long, and later rows are cut off.

    Only occupied cells are shuffled. An empty stretch is a run, unfolded afterwards: inside a chunk it follows the cell
    before it, over chunk edges it is found by a fold over the chunks and dealt to all tasks in blocks.
    """
    keys = list(keys)
    place = F.col(time_s) if origin_s == 0 else F.col(time_s) - F.lit(origin_s)
    cell = F.floor(place * F.lit(fps)).cast("long")
    early = F.raise_error(F.concat(F.lit("a row lies before the origin: "), F.col(time_s).cast("string"))).cast("long")
    binned = df.withColumn("idx", F.when(cell < 0, early).otherwise(cell)).filter(F.col("idx").isNotNull())
    if n_samples is not None:
        binned = binned.filter(F.col("idx") < n_samples)
    cells = occupied_cells(binned, keys, values, chunk)
    if n_samples is not None:
        lengths = df.select(*keys).distinct().withColumn("_n", F.lit(n_samples).cast("long"))
    else:
        lengths = binned.groupBy(*keys).agg((F.max("idx") + 1).alias("_n"))

    own = F.col("idx") == F.col("_cell")
    zero = lambda v: F.lit(0).cast(cells.schema[v].dataType)
    inside = explode_range(cells.withColumnRenamed("idx", "_cell"), F.col("_cell"), F.coalesce(F.col("_next") - 1, F.col("_cell")), "idx")
    filled = inside.select(*keys, "idx", *[F.when(own, F.col(v)).otherwise(zero(v)).alias(v) for v in values])
    # The ends of the chunks come from the times alone: a second, narrower scan, combined before its shuffle.
    empty = empty_runs(binned.select(*keys, "idx", floor_div(F.col("idx"), chunk).alias(CHUNK)), lengths, keys)
    return filled.unionByName(explode_range(empty, F.col("_from"), F.col("_to"), "idx").select(*keys, "idx", *[zero(v).alias(v) for v in values]))


def occupied_cells(binned: DataFrame, keys: list[str], values: list[str], chunk: int) -> DataFrame:
    """(keys, _chunk, idx, sums, _next): cells with rows, and the next one in the same chunk."""
    sums = binned.groupBy(*keys, "idx").agg(*[F.sum(v).alias(v) for v in values])
    return (sums.withColumn(CHUNK, floor_div(F.col("idx"), chunk))
            .withColumn("_next", F.lead("idx").over(Window.partitionBy(*keys, CHUNK).orderBy("idx"))))


def empty_runs(placed: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _from, _to) from rows placed by `idx` and chunk: the empty stretches before, between and behind the chunks' occupied cells, in blocks of FAN_OUT cells, spread."""
    chunks = placed.groupBy(*keys, CHUNK).agg(F.min("idx").alias("_first"), F.max("idx").alias("_last"))
    start = lengths.select(*keys, F.lit(-1).cast("long").alias(CHUNK), F.lit(None).cast("long").alias("_first"), F.lit(-1).cast("long").alias("_last"))
    follow = bucket_prefix(chunks.unionByName(start), keys, CHUNK, "_first", "last", "_follow", backwards=True)
    runs = follow.join(lengths, keys).select(*keys, (F.col("_last") + 1).alias("_a"), (F.coalesce("_follow", "_n") - 1).alias("_b")).filter("_a <= _b")
    steps = runs.withColumn("_block", F.explode(F.sequence(floor_div(F.col("_a"), FAN_OUT), floor_div(F.col("_b"), FAN_OUT))))
    base = F.col("_block") * F.lit(FAN_OUT).cast("long")
    return steps.repartition(*keys, "_block").select(*keys, F.greatest("_a", base).alias("_from"), F.least(F.col("_b"), base + F.lit(FAN_OUT - 1)).alias("_to"))

"""Chunked series processing.

A series may be far longer than one task can hold, so no operator opens a window over a whole
series. Samples are hash-partitioned by (series keys, chunk) where chunk = idx div size; frames
that reach over a chunk edge see copies of the neighbouring rows (the halo), and facts that travel
any distance go through a two-level summary with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakline.operators import limits

SERIES = ["game_id", "cam"]
CHUNK = "_chunk"
HOME = "_home"
DEFAULT_CHUNK = 3600
FAN_OUT = 4096


def floor_div(col: Column, size: int) -> Column:
    """Floor division of integers below 2^52 (`div` truncates towards zero)."""
    return F.floor(col / F.lit(size)).cast("long")


def explode_range(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per integer in [first, last], unfolded in two steps so that no array exceeds FAN_OUT."""
    block = F.explode(F.sequence(floor_div(F.col("_first"), FAN_OUT), floor_div(F.col("_last"), FAN_OUT)))
    base = F.col("_block") * F.lit(FAN_OUT).cast("long")
    unit = F.explode(F.sequence(F.greatest(F.col("_first"), base),
                                F.least(F.col("_last"), base + F.lit(FAN_OUT - 1).cast("long"))))
    return (df.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long"))
            .filter(F.col("_first") <= F.col("_last"))
            .withColumn("_block", block).withColumn(name, unit)
            .drop("_first", "_last", "_block"))


def with_chunk(df: DataFrame, size: int, idx: str = "idx") -> DataFrame:
    """Add the chunk number, keeping one that an upstream operator already partitioned by."""
    if CHUNK in df.columns:
        return df
    return df.withColumn(CHUNK, floor_div(F.col(idx), size))


def with_halo(df: DataFrame, size: int, before: int, after: int, idx: str = "idx") -> DataFrame:
    """Send each row to its own chunk (home) and to every chunk whose frame reaches it.

    A chunk sees the `before` rows ahead of its first row and the `after` rows behind its last.
    """
    if CHUNK in df.columns:
        df = df.drop(CHUNK)
    lowest = F.greatest(F.lit(0).cast("long"), floor_div(F.col(idx) - F.lit(after), size))
    highest = floor_div(F.col(idx) + F.lit(before), size)
    return (df.withColumn(CHUNK, F.explode(F.sequence(lowest, highest)))
            .withColumn(HOME, F.col(CHUNK) == floor_div(F.col(idx), size)))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """`df` shuffled by columns into the session's number of tasks.

    For steps whose work is not in their bytes: adaptive plans would gather a few megabytes in one task or leave a second wave to a few cores.
    """
    return df.repartition(stated_tasks(df), *by)


def stated_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def chunk_window(keys: Sequence[str] = SERIES, idx: str = "idx"):
    return Window.partitionBy(*keys, CHUNK).orderBy(idx)


def attach_by_chunk(df: DataFrame, scalars: DataFrame, keys: Sequence[str], last_chunk: str, series: int | None = None) -> DataFrame:
    """Join one row of scalars per series onto its samples without shuffling by series.

    Counted (`series`, if the caller has) and few, the scalars are broadcast. Otherwise they are repeated once per chunk and
    joined on (keys, chunk), so a series holding most of the rows still spreads over all tasks.
    """
    if (scalars.count() if series is None else series) <= limits.FEW_SERIES:
        return df.join(F.broadcast(scalars.drop(last_chunk)), list(keys), "left")
    per_chunk = explode_range(scalars, F.lit(0), F.col(last_chunk), CHUNK).drop(last_chunk)
    return df.join(per_chunk, [*keys, CHUNK], "left")


_PREFIX = {
    "max": lambda c, w=None: F.max(c) if w is None else F.max(c).over(w),
    "min": lambda c, w=None: F.min(c) if w is None else F.min(c).over(w),
    "sum": lambda c, w=None: F.sum(c) if w is None else F.sum(c).over(w),
    "last": lambda c, w=None: F.last(c, ignorenulls=True) if w is None else F.last(c, ignorenulls=True).over(w),
}


def bucket_prefix(summary: DataFrame, keys: Sequence[str], bucket: str, value: str, how: str,
                  out: str, backwards: bool = False, buckets: int | None = None, depth: int = 1) -> DataFrame:
    """For each (keys, bucket) row, fold `value` over all earlier buckets of the same keys.

    `how` is max, min, sum or last (nearest non-null). `backwards` folds over later buckets instead.
    Levels keep every window small: buckets inside a block of FAN_OUT, `depth` times over, then the blocks left, so a
    sparse axis takes a depth at which few blocks are left of its whole length. Where the
    caller has counted that no key has more than a few `buckets`, one window does.
    """
    step = F.col(bucket).desc() if backwards else F.col(bucket).asc()
    fold = _PREFIX[how]
    if depth == 0 or buckets is not None and buckets <= limits.FEW_BUCKETS:
        seen = fold(F.col(value), Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
        return summary.withColumn(out, F.coalesce(seen, F.lit(0).cast("long")) if how == "sum" else seen)
    block, total_, outer_, inner_ = (f"_{name}{depth}" for name in ("block", "total", "outer", "inner"))
    blocks = summary.withColumn(block, floor_div(F.col(bucket), FAN_OUT))
    inside = Window.partitionBy(*keys, block).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    if how == "last":
        nearest = F.min_by if backwards else F.max_by
        seen = F.when(F.col(value).isNotNull(), F.col(bucket))
        total = nearest(F.col(value), seen)
    else:
        total = fold(F.col(value))
    totals = blocks.groupBy(*keys, block).agg(total.alias(total_))
    outer = bucket_prefix(totals, keys, block, total_, how, outer_, backwards, depth=depth - 1).drop(total_)
    inner = blocks.withColumn(inner_, fold(F.col(value), inside))
    if how in ("max", "min"):
        merged = (F.greatest if how == "max" else F.least)(inner_, outer_)
    elif how == "sum":
        zero = F.lit(0).cast("long")
        merged = F.coalesce(inner_, zero) + F.coalesce(outer_, zero)
    else:
        merged = F.coalesce(inner_, outer_)
    return (inner.join(outer, [*keys, block], "left")
            .withColumn(out, merged).drop(block, inner_, outer_))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; counted on the map side first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and the number of groups."""
    largest, groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count("n")).first()
    return largest or 0, groups


def number_rows(df: DataFrame, keys: Sequence[str], levels: Sequence[tuple[str, Column]],
                order: Sequence[str], name: str) -> DataFrame:
    """1-based position of each row within `keys` by `order`.

    If the largest group has been counted and is small, a window over it will do. Otherwise no
    window spans a key: `levels` are ever finer bucket expressions, each monotone in `order` within
    the one above it; counts per bucket are summed level by level and only the rows of one finest
    bucket share a window.
    """
    if largest_group(df, keys) <= limits.SMALL_GROUP:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    names = [n for n, _ in levels]
    bucketed = df
    for level, expr in levels:
        bucketed = bucketed.withColumn(level, expr)
    counts = bucketed.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = None
    current = counts
    for depth in range(len(names) - 1, -1, -1):
        path = [*keys, *names[:depth + 1]]
        parent = path[:-1]
        before = Window.partitionBy(*parent).orderBy(names[depth]).rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("long"))
        step = current.select(*path, ahead.alias(f"_ahead{depth}"))
        offsets = step if offsets is None else offsets.join(step, path)
        current = current.groupBy(*parent).agg(F.sum("_rows").alias("_rows"))
    total = sum((F.col(f"_ahead{d}") for d in range(len(names))), F.lit(0).cast("long"))
    offsets = offsets.select(*keys, *names, total.alias("_ahead"))
    local = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    return (bucketed.join(offsets, [*keys, *names])
            .withColumn(name, local + F.col("_ahead")).drop("_ahead", *names))

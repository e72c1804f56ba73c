"""Exact linear-interpolated percentiles per series, safe for series of any length.

The built-in `percentile` keeps every distinct value of a group in one buffer, so it is used only
when the longest series has been counted and found short. Otherwise the wanted ranks are located
by counting: first in bins of about one percent relative width, then the rows of the few bins that
hold a wanted rank are split into 2^20 slices, and only the distinct values of one slice are
ordered. Every step is a partial aggregate; no step holds a whole series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakline.operators import limits
from peakline.operators.chunks import CHUNK, SERIES, attach_by_chunk, largest_group
from peakline.operators.cut import cut

_BINS_PER_OCTAVE = 64
_BIN_ORIGIN = 100_000  # larger than 64 * 1075, so bins of positive values stay positive
_SLICES = 1 << 20


def _value_bin(v: Column) -> Column:
    """A bin number that never decreases as the value grows."""
    octave = F.floor(F.log2(F.abs(v)) * _BINS_PER_OCTAVE).cast("int") + F.lit(_BIN_ORIGIN)
    return F.when(v > 0, octave).when(v < 0, -octave).otherwise(F.lit(0))


def percentile_name(measure: str, pct: float) -> str:
    return f"{measure}_p{pct:g}".replace(".", "_")


def exact_percentiles(df: DataFrame, measures: Mapping[str, Sequence[float]], keys: Sequence[str] = SERIES,
                      longest: int | None = None) -> DataFrame:
    """One row per series: `<measure>_p<pct>` and `<measure>_n` per measure, and the last chunk.

    `df` has the series keys, `_chunk` and one double column per measure. Nulls are ignored.
    `longest` saves counting the rows again where the caller knows the longest series.
    """
    if longest is None:
        longest = largest_group(df, keys)
    if longest <= limits.SHORT_SERIES:
        return cut(_buffered(df, measures, list(keys)))
    return cut(_counted(df, measures, list(keys)))


def _buffered(df: DataFrame, measures: Mapping[str, Sequence[float]], keys: list[str]) -> DataFrame:
    aggregates = [F.max(CHUNK).alias("last_chunk")]
    for m, pcts in measures.items():
        values = F.percentile(F.col(m), F.array(*[F.lit(float(p) / 100.0) for p in pcts]))
        aggregates += [F.count(m).alias(f"{m}_n"), values.alias(f"_{m}")]
    return df.groupBy(*keys).agg(*aggregates).select(
        *keys, "last_chunk", *[f"{m}_n" for m in measures],
        *[F.col(f"_{m}")[i].alias(percentile_name(m, p)) for m, pcts in measures.items() for i, p in enumerate(pcts)])


def _counted(df: DataFrame, measures: Mapping[str, Sequence[float]], keys: list[str]) -> DataFrame:
    targets = [(m, float(p), side) for m, pcts in measures.items() for p in pcts for side in ("lo", "hi")]
    names = list(measures)

    # Pass 1: counts per value bin.
    cells = [F.struct(F.lit(i).alias("m"), F.col(m).cast("double").alias("v")) for i, m in enumerate(names)]
    long = (df.select(*keys, CHUNK, F.explode(F.array(*cells)).alias("_cell"))
            .select(*keys, CHUNK, F.col("_cell.m").alias("m"), F.col("_cell.v").alias("v"))
            .filter(F.col("v").isNotNull())
            .withColumn("b", _value_bin(F.col("v"))))
    bins = long.groupBy(*keys, "m", "b").agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(CHUNK).alias("last_chunk"))
    series = Window.partitionBy(*keys, "m")
    upto = series.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("n", F.sum("c").over(series)).withColumn("below", F.sum("c").over(upto) - F.col("c"))

    def rank(pct: float, side: str) -> Column:
        position = F.lit(pct / 100.0) * (F.col("n") - F.lit(1))
        return (F.floor(position) if side == "lo" else F.ceil(position)).cast("long")

    wanted = F.array(*[
        F.struct(F.lit(t).alias("t"), F.when(F.col("m") == names.index(m), rank(p, side)).alias("r"))
        for t, (m, p, side) in enumerate(targets)])
    hits = F.filter(wanted, lambda x: (x.r >= F.col("below")) & (x.r < F.col("below") + F.col("c")))
    # The bins that hold a wanted rank: at most one row per target and series. `last_chunk` is the
    # largest chunk of the series, needed even when its bin holds no target.
    located = cut(bins.withColumn("last_chunk", F.max("last_chunk").over(series))
               .filter(F.size(hits) > 0)
               .withColumn("_hit", F.explode(hits))
               .select(*keys, "m", "b", "lo", "hi", "n", "last_chunk",
                       F.col("_hit.t").alias("t"), (F.col("_hit.r") - F.col("below")).alias("r")))

    per_series = located.groupBy(*keys).agg(
        F.max("last_chunk").alias("last_chunk"),
        *[F.max(F.when(F.col("t") == t, F.col(c))).alias(f"_{c}{t}") for t in range(len(targets)) for c in ("b", "lo", "hi")])

    # Pass 2: the rows of those bins, counted per distinct value.
    marked = attach_by_chunk(df.select(*keys, CHUNK, *names), per_series, keys, "last_chunk")
    picked = []
    for i, m in enumerate(names):
        mine = [t for t, target in enumerate(targets) if target[0] == m]
        v = F.col(m).cast("double")
        b = _value_bin(v)
        lo = F.coalesce(*[F.when(b == F.col(f"_b{t}"), F.col(f"_lo{t}")) for t in mine])
        hi = F.coalesce(*[F.when(b == F.col(f"_b{t}"), F.col(f"_hi{t}")) for t in mine])
        picked.append(F.struct(F.lit(i).alias("m"), b.alias("b"), v.alias("v"), lo.alias("lo"), hi.alias("hi")))
    width = F.col("hi") - F.col("lo")
    slice_no = F.when(width > 0, F.floor((F.col("v") - F.col("lo")) / width * _SLICES)).otherwise(F.lit(0))
    values = cut(marked.select(*keys, F.explode(F.array(*picked)).alias("_p")).select(*keys, "_p.*")
              .filter(F.col("lo").isNotNull())
              .withColumn("s", slice_no.cast("int"))
              .groupBy(*keys, "m", "b", "s", "v").agg(F.count(F.lit(1)).alias("c")))

    # Pass 3: the slice that holds the rank, then the value inside the slice.
    slices = values.groupBy(*keys, "m", "b", "s").agg(F.sum("c").alias("c"))
    within_bin = Window.partitionBy(*keys, "m", "b").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("below", F.sum("c").over(within_bin) - F.col("c"))
    found = (slices.join(located.select(*keys, "m", "b", "t", "r"), [*keys, "m", "b"])
             .filter((F.col("r") >= F.col("below")) & (F.col("r") < F.col("below") + F.col("c")))
             .select(*keys, "m", "b", "s", "t", (F.col("r") - F.col("below")).alias("r")))
    within_slice = (Window.partitionBy(*keys, "m", "b", "s").orderBy("v")
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    values = values.withColumn("below", F.sum("c").over(within_slice) - F.col("c"))
    exact = (values.join(found, [*keys, "m", "b", "s"])
             .filter((F.col("r") >= F.col("below")) & (F.col("r") < F.col("below") + F.col("c"))))
    by_target = exact.groupBy(*keys).agg(
        *[F.max(F.when(F.col("t") == t, F.col("v"))).alias(f"_v{t}") for t in range(len(targets))])
    sizes = located.groupBy(*keys).agg(
        F.max("last_chunk").alias("last_chunk"),
        *[F.max(F.when(F.col("m") == i, F.col("n"))).alias(f"{m}_n") for i, m in enumerate(names)])
    joined = sizes.join(by_target, keys)

    out = []
    for m, pcts in measures.items():
        for p in pcts:
            lo = F.col(f"_v{targets.index((m, float(p), 'lo'))}")
            hi = F.col(f"_v{targets.index((m, float(p), 'hi'))}")
            position = F.lit(float(p) / 100.0) * (F.col(f"{m}_n") - F.lit(1))
            # The built-in's own expression, so that both plans give the same bits.
            between = (F.ceil(position) - position) * lo + (position - F.floor(position)) * hi
            out.append(F.when(lo == hi, lo).otherwise(between).alias(percentile_name(m, p)))
    counts = [F.coalesce(F.col(f"{m}_n"), F.lit(0).cast("long")).alias(f"{m}_n") for m in names]
    return joined.select(*keys, "last_chunk", *counts, *out)

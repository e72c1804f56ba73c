"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r, the expected number of its copies in the mix. Among all rates between 0 and
`max_copies` that give each source its target number of words, the rates are those nearest to "each document
once" in relative entropy. Their form is r = min(max_copies, exp(lambda * size / mean size)), with one multiplier per
source: the solution of the convex dual, found by Newton steps. A step is one aggregation over a histogram
(source, size, documents), so neither a hot source nor a large group of copies meets in one task.

Rates become copies in two steps. Cells of the histogram, from the longest documents to the shortest, get whole
numbers of copies; the error carried on is at most half a document of the current size, so a source ends within half of its
shortest documents. Inside a cell the copies are dealt out evenly in hash order of the ids.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakline.llm.common import WORD, key_of, shipped, stored, whole_text
from peakline.operators.cut import cut

#: Documents of one (source, size) that are ranked in one window; larger cells are split by hash.
CELL_ROWS = 512


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: DataFrame, share: float, max_copies: float) -> DataFrame:
    """(key, source, source_size, target) of every source.

    Sources share `share` times all sizes by weight. A target stops at `max_copies` times its source's size and the
    excess is shared again by weight among the others until none is above. Only sums reach the driver.
    """
    totals = stored(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
                    .join(weights.select(key_of(F.col("source")).alias("key"), F.col("weight").cast("double").alias("weight")), "key", "left")
                    .withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    most = F.col("source_size") * float(max_copies)
    budget = (totals.agg(F.sum("source_size")).first()[0] or 0) * share
    level, closed = 0.0, -1
    while True:
        full = most <= F.col("weight") * level
        n, gone, open_weight = totals.agg(F.count(F.when(full, 1)), F.sum(F.when(full, most).otherwise(0.0)),
                                          F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == closed or not open_weight:
            break
        closed, level = n, max(level, (budget - gone) / open_weight)
    return totals.select("key", "source", "source_size", F.least(most, F.col("weight") * F.lit(level)).alias("target"))


def ranked_weights(sized: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """(source, weight): sources by code point, null last, take the weights of `cycle` in turn.

    The window runs over distinct sources, split by their first characters to number them in two levels.
    """
    sources = stored(sized.select("source").distinct().withColumn("head", F.coalesce(F.substring("source", 1, 4), F.lit(""))))
    null = F.col("source").isNull()
    heads = sources.groupBy(null.alias("last"), "head").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("last", "head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("last", F.col("head").alias("at"), before.alias("before"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("last", "head").orderBy("source")) - 1
    cycled = F.element_at(F.array(*map(F.lit, map(float, cycle))), (F.pmod(rank, F.lit(len(cycle))) + 1).cast("int"))
    return (sources.withColumn("last", null).join(heads.withColumnRenamed("last", "at_last"), (F.col("last") == F.col("at_last")) & (F.col("head") == F.col("at")))
            .select("source", cycled.alias("weight")))


def _rate(max_copies: float) -> Column:
    tilted = F.least(F.lit(max_copies), F.exp(F.col("lam") * F.col("size") / F.col("mean")))
    return F.when(F.col("size") == 0, 1.0).when(F.col("state") == "full", max_copies).when(F.col("state") == "none", 0.0).otherwise(tilted)


def tilt(cells: DataFrame, targets: DataFrame, max_copies: float, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """(key, mean, lam, state) of every source: damped Newton steps on the dual, all sources in each step.

    The derivative of the dual is the mix's words minus the target. It rises with lambda, so the points tried so far
    bracket the root; a step that leaves the bracket is replaced by its middle.
    """
    target, total = F.col("target"), F.col("source_size")
    means = cells.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    state = cut(targets.join(means, "key").select(
        "key", "target", "mean", F.when(target >= total * max_copies * (1 - 1e-12), "full").when(target <= 0, "none").otherwise("open").alias("state"),
        F.log(F.greatest(target, F.lit(1e-300)) / F.greatest(total, F.lit(1))).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))
    for _ in range(rounds):
        if not state.filter("state = 'open'").head(1):
            return state
        rate = _rate(max_copies)
        words = F.col("n") * F.col("size") * rate
        sums = cells.join(state.filter("state = 'open'"), "key").groupBy("key").agg(
            F.sum(words).alias("got"), F.sum(F.when(rate < max_copies, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        lam, got, slope = F.col("lam"), F.col("got"), F.col("slope")
        low = F.when(got < target, lam).otherwise(F.col("low"))
        high = F.when(got >= target, lam).otherwise(F.col("high"))
        # Newton on the logarithm of both sides, which is closer to a line than the sums themselves.
        step = lam + F.when((slope > 0) & (got > 0), F.log(target / got) * got / slope)
        inside = step.isNotNull() & (low.isNull() | (step > low)) & (high.isNull() | (step < high)) & (F.abs(step - lam) <= 8)
        middle = F.when(low.isNull(), lam - 4).when(high.isNull(), lam + 4).otherwise((low + high) / 2)
        done = (F.abs(got - target) <= target * tolerance) | ((high - low) <= F.abs(high) * 1e-14)
        state = cut(state.join(sums, "key", "left").select(
            "key", "target", "mean", F.when((F.col("state") == "open") & done, "solved").otherwise(F.col("state")).alias("state"),
            F.when((F.col("state") != "open") | done, lam).when(inside, step).otherwise(middle).alias("lam"),
            F.when(F.col("state") == "open", low).otherwise(F.col("low")).alias("low"), F.when(F.col("state") == "open", high).otherwise(F.col("high")).alias("high")))
    return state


def _whole_copies(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of every cell of one source: rounding, longest documents first, with the error carried on in words."""
    cells = cells.sort_values("size", ascending=False)
    carry, copies = 0.0, []
    for size, n, rate, most in zip(cells["size"], cells["n"], cells["rate"], cells["most"], strict=True):
        want = n * rate * size + carry
        m = min(max(math.floor(want / size + 0.5), 0), n * most) if size else n
        carry = want - m * size if size else carry
        copies.append(int(m))
    return cells.assign(copies=copies)[["key", "size", "n", "rate", "copies"]]


def mix(docs: DataFrame, weights: DataFrame | tuple[float, ...], share: float = 1.5, max_copies: int = 2, *, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How often the mix takes each document.

    weights: a table (source, weight), or numbers dealt to the sources in code point order, null last. Returns one row per row of
    `docs`: id_col, source, size, source_size, target, rate, copies, taken. Size is the number of words. A null text has
    size 0; a document without words weighs nothing and stays once. Null sources are one source. A source without a weight has
    target 0. Repeated rows count each; rows that tie in id and size share the copies in any order. Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(whole_text(text_col)).alias("size"))
    sized = stored(sized.withColumn("key", key_of(F.col("source"))))
    if isinstance(weights, tuple):
        weights = ranked_weights(sized, weights)
    targets = stored(source_targets(sized, weights, share, max_copies))
    cells = stored(sized.groupBy("key", "size").agg(F.count("*").alias("n")))
    state = tilt(cells, targets, float(max_copies))
    rated = cells.join(state.select("key", "mean", "lam", "state"), "key").select("key", "size", "n", _rate(float(max_copies)).alias("rate"), F.lit(max_copies).alias("most"))
    shipped(docs.sparkSession)
    # One group holds one row per distinct size of a source, however many documents there are.
    whole = stored(rated.groupBy("key").applyInPandas(_whole_copies, "key string, size long, n long, rate double, copies long"))
    slot = F.xxhash64("doc_id")
    placed = sized.join(whole, ["key", "size"]).withColumn("slot", slot).withColumn("part", F.pmod(F.xxhash64(slot), F.ceil(F.col("n") / CELL_ROWS)))
    rank = F.row_number().over(W.partitionBy("key", "size", "part").orderBy("slot", "doc_id"))
    placed = placed.withColumn("rank", rank.cast("long")).withColumn("offset", F.when(F.col("n") <= CELL_ROWS, 0).otherwise(F.pmod(F.xxhash64("key", "size", "part"), F.col("n"))))
    dealt = F.expr("((rank * copies + offset) div n) - (((rank - 1) * copies + offset) div n)")
    return placed.withColumn("copies", dealt).join(targets.drop("source"), "key").select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: DataFrame | tuple[float, ...], share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """The mix itself: every row of `docs` as often as the mix takes it, with the columns of `docs`.

    docs has at least doc_id, source and text. Rows that agree in id, source and size are told apart only by their order of text; for all
    others a plain join brings the copies back.
    """
    mixed = mix(docs, weights, share, max_copies).groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    mixed = mixed.select(F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size"), "copies")
    row = docs.select(F.struct("*").alias("row"), n_words(whole_text()).alias("row_size"))
    same = F.col("row.doc_id").eqNullSafe(F.col("of_id")) & F.col("row.source").cast("string").eqNullSafe(F.col("of_source")) & (F.col("row_size") == F.col("of_size"))
    # One row per document on both sides: always a shuffle, in the same way at every size.
    met = row.join(mixed.hint("merge"), same)
    once = met.filter(F.size("copies") == 1).withColumn("n", F.col("copies")[0])
    turn = F.row_number().over(W.partitionBy("of_id", "of_source", "of_size").orderBy("row.text"))
    often = met.filter(F.size("copies") > 1).withColumn("n", F.get("copies", turn - 1))
    return once.unionByName(often).filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")

"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from peakline.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): the label is the smallest node of its component.

    In every round each node points to the smallest of its neighbours and itself, pointers are followed to their roots in
    doubling steps, and the links are redrawn between roots; what remains has at most half as many nodes that are still linked.
    A star, the usual shape, takes one round. Minima are combined before the shuffle, which keeps a node with very many links from
    gathering them in one task.
    """
    open_ = stored(_both(links))
    labels = None
    while labels is None or not open_.isEmpty():
        least = open_.groupBy("a").agg(F.min("b").alias("least"))
        roots = _followed(stored(least.select(F.col("a").alias("node"), F.least("a", "least").alias("label"))))
        at = lambda node, label: roots.select(F.col("node").alias(node), F.col("label").alias(label))  # noqa: B023, E731
        if labels is None:
            labels = roots
        else:
            labels = stored(labels.join(at("was", "now"), F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label")))
        redrawn = open_.join(at("a", "la"), "a").join(at("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b")
        open_ = stored(redrawn.distinct())
    return labels


def _both(links: DataFrame) -> DataFrame:
    """Distinct links in both directions."""
    one = links.select("a", "b").filter("a <> b")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _followed(pointers: DataFrame) -> DataFrame:
    """(node, label) with every label followed to a node that points to itself."""
    while True:
        up = pointers.filter("node <> label").select(F.col("node").alias("at"), F.col("label").alias("above"))
        if pointers.filter("node <> label").join(up, F.col("label") == F.col("at"), "left_semi").isEmpty():
            return pointers
        pointers = stored(pointers.join(up, F.col("label") == F.col("at"), "left").select("node", F.coalesce("above", "label").alias("label")))

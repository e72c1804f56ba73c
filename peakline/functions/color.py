"""Colour classes of a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakline.config import COLOR_RANKS


def color_class(score: Column) -> Column:
    return (F.when(score > 1.60, "Red").when(score > 1.30, "Orange")
            .when(score > 1.00, "Yellow").otherwise("Blue"))


def color_rank(color: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in COLOR_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, color), F.lit(0))

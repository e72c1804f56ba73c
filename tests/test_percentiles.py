import numpy as np
import pytest
from pyspark.sql import functions as F

from peakline.operators import limits
from peakline.operators.percentiles import exact_percentiles

RNG = np.random.default_rng(5)
SERIES = {
    "noise": RNG.normal(size=997), "ties": RNG.integers(0, 4, 500).astype(float), "zeros": np.zeros(300), "one": np.array([3.5]),
    "two": np.array([1.0, 2.0]), "wide": 10.0 ** RNG.uniform(-200, 200, 400), "tiny": 1.0 + np.arange(300) * 2.0 ** -52,
    "mostly_zero": np.where(RNG.random(600) < 0.9, 0.0, RNG.random(600)), "signs": np.concatenate([-RNG.random(50), [0.0, -0.0], RNG.random(50)]),
}
PCTS = [0, 50, 70, 92.5, 99, 100]


@pytest.mark.parametrize("short", [10 ** 6, 0])
def test_equals_linear_percentile(spark, short, monkeypatch):
    monkeypatch.setattr(limits, "SHORT_SERIES", short)
    monkeypatch.setattr(limits, "FEW_SERIES", short)
    rows = [(name, 1, i // 64, float(v), float(-v)) for name, x in SERIES.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "game_id string, cam int, _chunk long, a double, b double")
    got = exact_percentiles(df, {"a": PCTS, "b": [99]}).collect()
    assert len(got) == len(SERIES)
    for row in got:
        x = SERIES[row.game_id]
        assert row.a_n == row.b_n == len(x)
        for p in PCTS:
            assert row[f"a_p{p:g}".replace(".", "_")] == pytest.approx(np.percentile(x, p), rel=1e-12, abs=1e-300)
        assert row.b_p99 == pytest.approx(np.percentile(-x, 99), rel=1e-12, abs=1e-300)


def test_counted_path_ignores_nulls(spark, monkeypatch):
    monkeypatch.setattr(limits, "SHORT_SERIES", 0)
    df = spark.range(1000).select(F.lit(1).alias("game_id"), F.lit(1).alias("cam"), F.floor(F.col("id") / 10).alias("_chunk"),
                                  F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("a"), F.col("id").cast("double").alias("b"))
    row = exact_percentiles(df, {"a": [50], "b": [50]}).first()
    assert (row.a_n, row.b_n, row.last_chunk) == (500, 1000, 99)
    assert (row.a_p50, row.b_p50) == (499.0, 499.5)


def test_both_plans_give_the_same_bits(spark, monkeypatch):
    values = np.random.default_rng(11).normal(size=(8, 700)) * 50
    df = spark.createDataFrame([(g, 1, i // 100, float(v)) for g, x in enumerate(values) for i, v in enumerate(x)], "game_id int, cam int, _chunk long, a double")
    pcts = [1, 33.3, 70, 95, 97.5, 99]
    small = sorted(map(tuple, exact_percentiles(df, {"a": pcts}).collect()))
    monkeypatch.setattr(limits, "SHORT_SERIES", 0)
    assert sorted(map(tuple, exact_percentiles(df, {"a": pcts}).collect())) == small

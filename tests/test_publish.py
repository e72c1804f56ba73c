"""Several documents by one job, published together."""

import os

import pytest
from pyspark.sql import functions as F

from peakline import DetectConfig
from peakline.plans import batch
from peakline.sources.publish import publish, published

LINES = "kind string, game_id int, major double, minor double, line string"


def read(path):
    """{game: [lines of each file]}"""
    out = {}
    for folder in sorted(os.listdir(path)):
        if folder.startswith("game_id="):
            out[int(folder[8:])] = [open(f"{path}/{folder}/{f}").read().splitlines() for f in sorted(os.listdir(f"{path}/{folder}")) if f.startswith("part-")]
    return out


def test_every_file_has_its_header_and_all_lines_are_in_order(spark, tmp_path):
    rows = [("t", 1, float(k), 0.0, f"row {k}") for k in range(5000)] + [("t", 2, float("-inf"), 0.0, None), ("t", 1, float("-inf"), 0.0, None)]
    rows += [("x", 1, 0.0, float(-k), f"line {k}") for k in range(50)] + [("t", 3, 1.0, 0.0, ""), ("x", 3, 1.0, 0.0, 'two\nlines')]
    table = spark.createDataFrame(rows[::-1], LINES).repartition(5)
    paths = publish(table, str(tmp_path), {"t": "head"}, ["t", "x"])
    t, x = read(paths["t"]), read(paths["x"])
    assert len(t[1]) > 1
    assert set(t) == {1, 2, 3} and set(x) == {1, 3}
    assert all(part[0] == "head" and part.count("head") == 1 for parts in t.values() for part in parts)
    assert [line for part in t[1] for line in part[1:]] == [f"row {k}" for k in range(5000)]
    assert t[2] == [["head"]] and t[3] == [["head", ""]]
    assert [line for part in x[1] for line in part] == [f"line {k}" for k in reversed(range(50))] and x[3] == [["two", "lines"]]


def test_a_failing_document_publishes_nothing(spark, tmp_path, monkeypatch):
    """The run that is killed in its second kind leaves the documents of the run before."""
    good = spark.createDataFrame([("a", 0, 0.0, 0.0, "one"), ("b", 0, 0.0, 0.0, "two")], LINES)
    first = publish(good, str(tmp_path), {}, ["a", "b"])
    bad = good.withColumn("line", F.when(F.col("kind") == "b", F.raise_error(F.lit("killed"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="killed"):
        publish(bad, str(tmp_path), {}, ["a", "b"])
    assert published(spark, str(tmp_path), ["a", "b"]) == first and read(first["a"]) == {0: [["one"]]}
    second = publish(good.withColumn("line", F.lit("new")), str(tmp_path), {}, ["a", "b"])
    assert second != first and published(spark, str(tmp_path), ["a", "b"]) == second


def test_batch_killed_in_its_second_sink(spark, tmp_path, monkeypatch):
    cfg = DetectConfig.live(fps=4)
    quiet = spark.range(100).select(F.lit(0).alias("game_id"), F.lit(1).alias("cam"), F.col("id").alias("idx"), *[F.lit(0.0).alias(c) for c in ("net", "slot", "audio")])
    paths = batch.run_game_batch(spark, quiet, str(tmp_path), cfg)
    real = batch.marker_lines
    monkeypatch.setattr(batch, "marker_lines", lambda markers: real(markers).unionByName(
        markers.sparkSession.range(1).select(F.lit(0).alias("game_id"), F.lit(0.0).alias("major"), F.lit(0.0).alias("minor"), F.raise_error(F.lit("killed")).cast("string").alias("line"))))
    with pytest.raises(Exception, match="killed"):
        batch.run_game_batch(spark, quiet, str(tmp_path), cfg)
    assert published(spark, str(tmp_path), batch.KINDS) == paths
    assert read(paths["events"]) == {0: [["start_s,end_s,score,primary_cam,confidence"]]} and read(paths["edl"])[0][0][0].startswith("TITLE")

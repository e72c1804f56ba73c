"""Delimited text with quoted line breaks: many small blocks against one reader of the whole file."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from peakline.operators import limits
from peakline.sources.records import ends_inside, fields, quoted_records
from peakline.sources.tables import MARKER_HEADER, read_markers

BITS = ["a", "é", " ", ",", '"', "\n", '""', "12.5", "\r\n", "x" * 30, "line\nbreak"]


def text_of(rng, n):
    rows = [["".join(rng.choice(BITS) for _ in range(rng.randint(0, 6))).replace("\r\n", "\n") for _ in range(4)] for _ in range(n)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return rows, out.getvalue()


def test_state_at_the_end_of_lines():
    for line, out, inside in [("a,b", False, True), ('"a', True, False), ('"a"', False, False), ('a"b', False, False), ('"a""', True, False), ('a,"b"",', True, False),
                              ('",', True, False), ('"', True, False), ('""', False, True), ("", False, True), ('x","y', True, True), ('"a"b,"c', True, True)]:
        assert (ends_inside(line, False, ",", '"'), ends_inside(line, True, ",", '"')) == (out, inside), line


@pytest.mark.parametrize("block", [64, 1000, 10 ** 6])
@pytest.mark.parametrize("broadcast", [True, False])
def test_records_of_small_blocks(spark, tmp_path, monkeypatch, block, broadcast):
    """Records over several blocks, blocks inside one field, quotes in unquoted fields."""
    if not broadcast:
        monkeypatch.setattr(limits, "FEW_SERIES", -1)
    rng = random.Random(block)
    rows, text = text_of(rng, 120)
    long = ["1", "many\n" * 150 + 'end "quoted" ' + "z" * 300, "", "2"]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(long)
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "a.csv").write_text(text + out.getvalue() + text)
    (folder / "b.csv").write_text('x"y,2 "3",4,5\n' + text.rstrip("\n"))
    (folder / "c.csv").write_text('1,"never closed,3\n4,5')
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = quoted_records(spark, str(folder))
        assert lines.count() == 2 * len(rows) + 1 + len(rows) + 1 + 1
        table = fields(lines, 4)
        got = {}
        for r in table.orderBy("file", "pos").collect():
            got.setdefault(os.path.basename(r["file"]), []).append([c or "" for c in r["fields"]])
        if block < 10 ** 5:
            assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got["a.csv"] == [*rows, long, *rows]
    assert got["b.csv"] == [['x"y', '2 "3"', "4", "5"], *rows]
    assert len(got["c.csv"]) == 1 and got["c.csv"][0][0] == "1"
    first = {os.path.basename(r["file"]): r["pos"] for r in lines.groupBy("file").agg(F.min("pos").alias("pos")).collect()}
    assert set(first.values()) == {0}


def test_markers_equal_the_whole_file_reader(spark, tmp_path):
    """A file of megabytes with quoted line breaks, read by several tasks, gives the rows of the reader that takes it as one."""
    rng = random.Random(2)
    names = ["PLAY cam1", 'say "x"', "two\nlines", "a,b", "", " padded "]
    for game, n in ((0, 30_000), (7, 500)):
        folder = tmp_path / f"game_id={game}"
        folder.mkdir()
        with open(folder / "part-0.csv", "w", newline="") as file:
            out = csv.writer(file, lineterminator="\r\n" if game else "\n")
            out.writerow([" Note", "Frame ", "Name", "Color", "Duration", "More"])
            out.writerows([rng.choice(names), rng.choice([str(k), "bad", f" {k}.5", ""]), "long note\n" * rng.randint(0, 3), "Red", "n/a", "m"] for k in range(n))
    assert os.path.getsize(tmp_path / "game_id=0" / "part-0.csv") > 1_000_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = read_markers(spark, str(tmp_path)).orderBy("game_id", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    table = spark.read.csv(str(tmp_path), header=True, quote='"', escape='"', multiLine=True)
    whole = {}
    for row in table.withColumn("_n", F.monotonically_increasing_id()).orderBy("game_id", "_n").collect():
        cells = {c.strip(): (row[c] or "").strip(" \t\n\r\x0b\x0c") for c in table.columns if c not in ("game_id", "_n")}
        try:
            float(cells["Frame"])
        except ValueError:
            continue
        whole.setdefault(row["game_id"], []).append(tuple(cells[c] for c in MARKER_HEADER))
    mine = {}
    for row in got:
        mine.setdefault(row["game_id"], []).append(tuple(row[c] for c in MARKER_HEADER))
    assert mine == whole and len(mine[0]) > 10_000


def test_another_header_is_an_error(spark, tmp_path):
    for k, head in enumerate(("Frame,Name,Note,Color,Duration", "Frame,Note,Name,Color,Duration")):
        folder = tmp_path / f"game_id={k}"
        folder.mkdir()
        (folder / "a.csv").write_text(head + "\n1,a,b,c,d\n")
    with pytest.raises(Exception, match="another header"):
        read_markers(spark, str(tmp_path)).collect()

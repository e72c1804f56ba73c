"""Text documents of several kinds for every game, written by one job and published together.

A run writes all of its documents below a folder of its own. Only when that job has ended does a row of the run register name the folder, so
readers see the documents of one whole run: a run that fails in any of them leaves the published ones as they were.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakline.operators.chunks import stated_tasks
from peakline.operators.workers import shipped

REGISTER = "_published"
ORDER = ["kind", "game_id", "major", "minor"]


def _with_headers(batches: Iterator[pa.RecordBatch], headers: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    """The sorted lines of a task with their place; the first line of a document in it, and so in a file, comes behind the kind's header."""
    before, n = None, 0
    for batch in batches:
        kinds, games, lines = (batch.column(c) for c in ("kind", "game_id", "line"))
        at, place, out = [], [], []
        for i, (kind, game, line) in enumerate(zip(kinds.to_pylist(), games.to_pylist(), lines.to_pylist(), strict=True)):
            for value in ([headers[kind]] if (kind, game) != before and kind in headers else []) + ([] if line is None else [line]):
                at.append(i)
                place.append(n)
                out.append(value)
                n += 1
            before = (kind, game)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([kinds.take(take), games.take(take), pa.array(place, pa.int64()), pa.array(out, pa.string())], names=["kind", "game_id", "n", "value"])


def publish(lines: DataFrame, out: str, headers: Mapping[str, str], kinds: list[str]) -> dict[str, str]:
    """Writes (kind, game_id, major, minor, line) in order and returns the folder of each kind, with one folder per game.

    One shuffle deals all documents by kind, game and order, so a large document becomes several ordered files and many small ones share a task. A kind in
    `headers` has its header in every file; a null line stands for a document that may hold nothing else.
    """
    shipped(lines.sparkSession)
    spark, run = lines.sparkSession, f"run-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    game = lines.schema["game_id"].dataType.simpleString()
    # A stated number of tasks: most of the work is opening files, which adaptive plans would gather in one task for their few bytes.
    dealt = lines.select(*ORDER, "line").repartitionByRange(stated_tasks(lines), *ORDER).sortWithinPartitions(*ORDER)
    ordered = dealt.mapInArrow(lambda batches: _with_headers(batches, headers), f"kind string, game_id {game}, n long, value string")
    ordered.sortWithinPartitions("kind", "game_id", "n").drop("n").write.partitionBy("kind", "game_id").text(f"{out}/{run}")
    spark.createDataFrame([(run, time.time_ns())], "run string, at long").coalesce(1).write.mode("append").json(f"{out}/{REGISTER}")
    return _folders(out, run, kinds)


def _folders(out: str, run: str, kinds: list[str]) -> dict[str, str]:
    return {kind: f"{out}/{run}/kind={kind}" for kind in kinds}


def published(spark: SparkSession, out: str, kinds: list[str]) -> dict[str, str]:
    """The folders of the run published last."""
    run = spark.read.schema("run string, at long").json(f"{out}/{REGISTER}").agg(F.max_by("run", "at")).first()[0]
    return _folders(out, run, kinds)

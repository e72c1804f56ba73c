"""Cutting lineage through the session's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables, shared by all executors.

    It is the one the session names in `spark.checkpoint.dir`. Only a local session without that
    setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="peakline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once, written as Parquet to the checkpoint folder and read from there from then on.

    Used where a result feeds several later steps: without it every step would replan and recompute
    the whole chain above. The copy survives the loss of executors, and a step reads only the columns it names.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, **totals: Column) -> tuple[DataFrame, dict[str, Any]]:
    """`cut(df)`, and aggregates over its rows taken by the job that writes them.

    A step that is computed again after a loss may be counted twice, so counts are right or too large: fit for choosing a plan
    and for asking whether there is anything, not as results.
    """
    seen = Observation()
    rows = cut(df.observe(seen, *[total.alias(name) for name, total in totals.items()]))
    return rows, seen.get

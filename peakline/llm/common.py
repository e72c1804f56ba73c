"""What the corpus operators share: words, scratch tables in the shared folder, rows in global order."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import peakline
from peakline.operators.cut import checkpoint_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one task of the byte-heavy operators should hold.
TASK_BYTES = 8_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Hands this package to the session's workers, once, as `--py-files` would. Tasks import it by name, and so keep
    what they remember between tasks."""
    context, folder = spark.sparkContext, Path(peakline.__file__).parent
    if context.applicationId in _SHIPPED or not folder.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="peakline-")) / "peakline.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(folder.rglob("*.py")):
            file.write(path, path.relative_to(folder.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """`mapInArrow` by workers that can import this package."""
    shipped(df.sparkSession)
    return df.mapInArrow(run, schema)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once, written as Parquet to the shared folder and read from there.

    Cuts lineage like a checkpoint, but compressed and with column pruning. Any executor can read the
    files, so the loss of one costs nothing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_of(column: Column) -> Column:
    """A never-null string that is equal exactly for equal (or both null) values, for joins and grouping."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), text))

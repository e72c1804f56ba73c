"""Handing this package to the workers of a session, for the few steps that run Python there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import peakline

_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Once per application, as `--py-files` would: tasks import the package by name. Executors fetch the archive from the driver as long as it runs."""
    context, folder = spark.sparkContext, Path(peakline.__file__).parent
    if context.applicationId in _SHIPPED or not folder.is_dir():
        return
    place = tempfile.mkdtemp(prefix="peakline-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    archive = Path(place) / "peakline-core.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(folder.rglob("*.py")):
            file.write(path, path.relative_to(folder.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)

"""cohortlens: embedding cohorts, their centroids and the tables around them, as PySpark DataFrame functions."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors, once per application; needed where it is not installed on them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    copy = Path(tempfile.mkdtemp(prefix="cohortlens-ship-"))  # read by the driver only; Spark serves it to the executors
    shutil.copytree(package, copy / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(copy / package.name), "zip", copy / "src"))
    _shipped.add(context.applicationId)

"""Making the package importable on executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources with the session's tasks, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    handle, path = tempfile.mkstemp(prefix="docquarry-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, f"{_PACKAGE.name}/{file.relative_to(_PACKAGE)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)

"""Sending this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless the path they inherit has it."""
    package = Path(__file__).resolve().parent
    inherited = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if package.parent in inherited or (app := spark.sparkContext.applicationId) in _shipped:
        return
    file = Path(tempfile.mkdtemp(prefix="duskwave-")) / f"{package.name}.zip"
    with zipfile.ZipFile(file, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(app)

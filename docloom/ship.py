"""Making this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless PYTHONPATH already has it there."""
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    application = spark.sparkContext.applicationId
    if ROOT in paths or application in _shipped:
        return
    _shipped.add(application)
    target = Path(tempfile.mkdtemp()) / "docloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((ROOT / "docloom").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))

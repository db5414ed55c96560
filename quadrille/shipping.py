"""Make this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_NAME = "quadrille_code.zip"


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once per Spark context."""
    sc = spark.sparkContext
    if _NAME in sc._python_includes:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="quadrille-ship-"), _NAME)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)

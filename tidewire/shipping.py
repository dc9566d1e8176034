"""Sends this package to the executors, for sessions that were not started with it on their Python path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application once; Python workers can then import it on any machine."""
    context = spark.sparkContext
    if getattr(context, "_tidewire_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidewire-")) / "tidewire.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(str(target))
    context._tidewire_shipped = True

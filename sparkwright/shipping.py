"""Makes the package importable on the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package's sources to the executors once per application (Spark's own file server spreads them)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    at = os.path.join(tempfile.mkdtemp(prefix="sparkwright-"), "sparkwright.zip")
    with open(at, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(at)
    _SHIPPED.add(context.applicationId)

"""Send this package to the executors, so that functions that run in Python workers can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the session's application, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return spark

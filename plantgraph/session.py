"""Making this package importable where Spark runs Python."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="plantgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"{folder}/plantgraph.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        spark.sparkContext.addPyFile(path)
    return spark

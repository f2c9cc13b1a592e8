"""Makes this package importable in the Python workers of a session, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to all executors, once for an application; Spark's own file server carries them."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="domframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the archive when they need it
    archive = f"{folder}/{home.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)

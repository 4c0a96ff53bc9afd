"""Making the package known to a cluster's Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's source to the executors, once for each application, as spark-submit --py-files would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix=f"{top.name}-")  # the driver serves the archive from there as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    tree = Path(folder, "tree")
    shutil.copytree(top, tree / top.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", tree))
    _shipped.add(app)

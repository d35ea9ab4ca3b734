"""Make this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    Spark distributes the archive itself, so the executors need no shared folder.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="ship-"))
    archive = os.path.join(folder, "tickloom_sources.zip")
    root = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)

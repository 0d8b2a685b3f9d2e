"""Give the package to the Python workers, wherever the driver was started from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files once; workers then import it by name."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="docframe-ship-"), "docframe_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _DONE.add(context.applicationId)

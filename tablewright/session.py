"""The package on the workers of a session, wherever the driver was started."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the session's Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_tablewright_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    # Spark's own folder on the driver, from which it serves the file to the executors
    path = os.path.join(context._temp_dir, "tablewright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._tablewright_shipped = True
    return spark


def shared_path(spark: SparkSession, label: str, given: str | None = None) -> str:
    """A new folder for intermediate tables: below the given one, else below the session's spark.checkpoint.dir.

    Where neither is set, only a local session gets one, below its warehouse.
    """
    root = given or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all machines share.")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

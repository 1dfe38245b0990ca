"""Ships this package to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Rows that Spark sends to a Python worker at once, at most: with whole texts, 10,000 of them (its default) are some 30 MB in the task and in its worker.
BATCH = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Adds a zip of the package to the application, once; Spark serves it to every Python worker.  The session's Arrow batches get ``BATCH`` rows at most."""
    context = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH:
        spark.conf.set(rows, str(BATCH))
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "curata_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("curata", os.path.relpath(full, root)))
        context.addPyFile(path)
    return spark

"""Makes this package importable by Python workers that don't share the driver's folders."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "500"


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once for each Spark application. Unless the user chose another,
    Arrow batches get ``BATCH_ROWS`` rows: with Spark's 10,000, a batch of long texts takes gigabytes on both sides."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="tidelog-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(path)
        atexit.register(lambda: os.path.exists(path) and os.remove(path))
        _shipped.add(sc.applicationId)
    return spark

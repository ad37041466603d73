"""Makes this package known to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Texts may be long: Arrow batches are kept small where the session has Spark's defaults.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's files, once; workers then import it from there wherever they run. Bounds Arrow's batches."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="lakeweave-"), "lakeweave.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.join("lakeweave", os.path.relpath(os.path.join(folder, n), top)))
        sc.addPyFile(path)
        for key, most in BATCH.items():
            if spark.conf.get(key, None) in (None, "10000", "-1", "67108864b"):
                spark.conf.set(key, most)
        _SHIPPED.add(sc.applicationId)
    return spark

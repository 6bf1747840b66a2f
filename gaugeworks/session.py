"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows that pass between the JVM and Python at a time. Texts are long: Spark's 10,000 would hold some hundred MB of them
#: in each task, off the heap and in Python.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, as --py-files would, and keep Arrow batches small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="gaugeworks-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(to))
        _shipped.add(sc.applicationId)
    return spark

"""Makes this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per session, so that jobs run wherever the driver was started."""
    context = spark.sparkContext
    if not getattr(context, "_quarry_shipped", False):
        top = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="quarry-ship-"), "quarry-package.zip")
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, str(path.relative_to(top.parent)))
        context.addPyFile(target)
        context._quarry_shipped = True
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # long texts: smaller batches than Spark's default
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark

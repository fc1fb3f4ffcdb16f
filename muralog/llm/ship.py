"""The package's code for Python workers that do not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Rows of an Arrow batch: texts of some kilobytes each are held twice, by Spark and by the worker.
BATCH_ROWS = 2000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark once per application; Spark brings it to every worker. Batches of texts are kept small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="muralog-code-")
        context.addPyFile(shutil.make_archive(f"{folder}/muralog", "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(context.applicationId)

"""The package on executors that do not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors of the session, once for each Spark context.

    Spark hands the archive to every executor, also to those that come later, so that its
    Python workers can import the package wherever the driver was started.
    """
    context = spark.sparkContext
    if getattr(context, "_hopmetrics_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="hopmetrics-package-")
    staged = f"{folder}/source"
    shutil.copytree(_PACKAGE, f"{staged}/hopmetrics", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/hopmetrics", "zip", staged, "hopmetrics"))
    context._hopmetrics_shipped = True

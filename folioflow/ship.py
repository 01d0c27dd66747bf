"""Make the package importable in every executor's Python workers."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


@contextmanager
def by_value():
    """Pickle the package's own classes whole while a stateful processor is being registered.

    Spark starts an extra Python process for such processors that does not see shipped files.
    """
    modules = [m for n, m in sys.modules.items() if n == "folioflow" or n.startswith("folioflow.")]
    for module in modules:
        cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        for module in modules:
            cloudpickle.unregister_pickle_by_value(module)


def ship(spark: SparkSession) -> None:
    """Distribute the package once per application as a zip through Spark."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "folioflow")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "folioflow"))
    _shipped.add(app)

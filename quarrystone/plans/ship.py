"""Getting this package to executors that do not have it installed."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", top.parent, top.name))


def shipped(f: Callable) -> Callable:
    """``f``, whose first argument is a session, after the package is sent."""

    @functools.wraps(f)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return f(spark, *rest)

    return run

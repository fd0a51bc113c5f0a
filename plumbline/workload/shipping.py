"""Make the package importable in Python workers that don't share the driver's import path."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import plumbline


def shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The same query, after Spark has been given this package for its workers."""

    def ready(spark: SparkSession, folder: str) -> DataFrame:
        context = spark.sparkContext
        if not getattr(context, "_has_plumbline", False):
            package = os.path.dirname(os.path.abspath(plumbline.__file__))
            held = tempfile.mkdtemp(prefix="plumbline-package-")  # the driver serves it to the workers
            name = os.path.join(held, "plumbline_package")
            context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), "plumbline"))
            context._has_plumbline = True
        return run(spark, folder)

    return ready

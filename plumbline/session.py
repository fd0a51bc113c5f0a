"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    # Run-time re-planning: coalesces small shuffle partitions, splits hot ones
    # and swaps in a broadcast join only after the side's real size is known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # All timestamps are wall-clock (NTZ); UTC keeps casts free of DST gaps.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Checks build hundreds of column expressions; recording the Python call site
    # of each one costs more than planning them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(name: str = "plumbline", cpus: str | int = "*", **extra) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **{k.replace("__", "."): str(v) for k, v in extra.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """
    The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only when the session names none (tests, a laptop) is a local one created
    and recorded in the session, so later calls share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    folder = getattr(spark, "_plumbline_folder", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark._plumbline_folder = folder
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex[:12]}")


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """
    Inside, a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage,
    and a long run holds those of all its jobs on disk. What is kept in a cache stays.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)

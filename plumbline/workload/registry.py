"""All queries by name: how Spark runs each, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.workload import compare, io, layers, loads, logs, saved, suite
from plumbline.workload.feed import Feed

MODULES = [compare, layers, logs, loads, io, saved, suite]


def _all() -> dict[str, tuple[Callable[[Feed], DataFrame], str | None]]:
    found: dict = {}
    for module in MODULES:
        for name, entry in module.queries().items():
            if name in found:
                raise ValueError(f"query {name} is defined twice")
            found[name] = entry
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        return lambda spark, folder: build(Feed(spark, folder))

    return {name: runner(build) for name, (build, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _all().items() if text}

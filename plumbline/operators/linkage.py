"""Referential checks between a detail table and the tables it points at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linked(detail: DataFrame, key: str, *parents: DataFrame) -> DataFrame:
    """
    Detail rows whose key is in at least one parent.

    One semi join against the stacked key sets replaces an OR of EXISTS tests.
    A semi join needs no distinct on its right side, and a hot detail key is
    split at run time because only the left side grows with it.
    """
    return detail.join(_keys(key, parents), key, "left_semi")


def unlinked(detail: DataFrame, key: str, *parents: DataFrame) -> DataFrame:
    """Detail rows whose key is in none of the parents; a NULL key is unlinked."""
    return detail.join(_keys(key, parents), key, "left_anti")


def apart(detail: DataFrame, keys: list[str], others: DataFrame) -> DataFrame:
    """
    Detail rows that share their keys with none of ``others``; NULL is a value like any other. Frames that both lie by
    one of the keys are matched where they lie, which a join on several keys does not do.
    """
    stacked = detail.unionByName(others.select(*keys, F.lit(True).alias("_other")), allowMissingColumns=True)
    met = F.max("_other").over(Window.partitionBy(*keys))
    return stacked.withColumn("_met", met).filter("_met IS NULL").select(*detail.columns)


def _keys(key: str, parents: tuple[DataFrame, ...]) -> DataFrame:
    # Under a name of their own: Spark then sees that a stack of keys lies as its parts do, and leaves it where it is.
    keys = [p.select(F.col(key).alias("_key")) for p in parents]
    stacked = keys[0]
    for more in keys[1:]:
        stacked = stacked.unionByName(more)
    return stacked.withColumnRenamed("_key", key)

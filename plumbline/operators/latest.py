"""Pick one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """
    The first row of each key under ``order`` (make the order total).

    The ``row_number() = 1`` filter is planned with a per-partition group limit
    before the shuffle, so a hot key sends one row per input partition.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def latest_version(df: DataFrame, key: str) -> DataFrame:
    """The most recent version of a record that any batch delivered."""
    return latest_by(
        df,
        [key],
        [F.col("RECORD_EFFECTIVE_TS").desc_nulls_last(), F.col("BATCH_ID").desc_nulls_last()],
    )


def latest_execution(log: DataFrame) -> DataFrame:
    """Each test's most recent execution."""
    return latest_by(
        log, ["test_case_id"], [F.col("run_ts").desc_nulls_last(), F.col("execution_id").asc()]
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")

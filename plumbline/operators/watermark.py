"""Incremental high-water marks: one row per load process."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import schemas


def batch_stats(layers: dict[str, DataFrame]) -> DataFrame:
    """Low, high and row count per process; processes the batch did not carry are absent."""
    parts = [
        rows.agg(
            F.lit(process).alias("PROCESS_NAME"),
            F.min("RECORD_EFFECTIVE_TS").alias("LOW"),
            F.max("RECORD_EFFECTIVE_TS").alias("HIGH"),
            F.count(F.lit(1)).alias("N"),
        ).filter("N > 0")
        for process, rows in layers.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def next_watermark(
    state: DataFrame, stats: DataFrame, batch_id: str, now: Column | None = None
) -> DataFrame:
    """
    The state after a batch. Per process with rows in the batch:

    * never seen: no lower bound;
    * a different batch came last: start where that one ended;
    * the same batch again: keep the start it was first given, except that a
      start equal to the batch's own low (an old format) means no lower bound.

    The high mark is always the batch's, even when that moves it down. Other
    processes keep their row. Both inputs hold one row per process.
    """
    moved = F.col("s.LAST_BATCH_ID").isNull() | (F.col("s.LAST_BATCH_ID") != batch_id)
    own_low = F.col("s.PREVIOUS_WATERMARK") == F.col("b.LOW")
    start = (
        F.when(F.col("s.PROCESS_NAME").isNull(), F.lit(None))
        .when(moved, F.col("s.BATCH_HIGH_WATERMARK"))
        .when(own_low, F.lit(None))
        .otherwise(F.col("s.PREVIOUS_WATERMARK"))
    )
    touched = F.col("b.PROCESS_NAME").isNotNull()
    stamp = F.lit(None).cast("timestamp_ntz") if now is None else now

    def either(new: Column, name: str, type_: str) -> Column:
        return F.when(touched, new).otherwise(F.col(f"s.{name}")).cast(type_).alias(name)

    t = schemas.types(schemas.DQ_WATERMARK)
    inserted = F.col("s.PROCESS_NAME").isNull()
    return state.alias("s").join(
        stats.alias("b"), F.col("s.PROCESS_NAME") == F.col("b.PROCESS_NAME"), "full_outer"
    ).select(
        F.coalesce("b.PROCESS_NAME", "s.PROCESS_NAME").alias("PROCESS_NAME"),
        either(start, "PREVIOUS_WATERMARK", t["PREVIOUS_WATERMARK"]),
        either(F.col("b.HIGH"), "BATCH_HIGH_WATERMARK", t["BATCH_HIGH_WATERMARK"]),
        either(F.lit(batch_id), "LAST_BATCH_ID", t["LAST_BATCH_ID"]),
        either(F.col("b.N"), "ROWS_PROCESSED", t["ROWS_PROCESSED"]),
        either(F.lit("SUCCESS"), "LOAD_STATUS", t["LOAD_STATUS"]),
        either(F.lit("PENDING"), "VALIDATION_STATUS", t["VALIDATION_STATUS"]),
        either(F.when(~inserted, stamp), "UPDATED_TS", t["UPDATED_TS"]),
    )


def validation_window(layers: list[DataFrame]) -> DataFrame:
    """One row: first and last day any record of the batch is effective."""
    stamps = reduce(
        DataFrame.unionByName, [rows.select("RECORD_EFFECTIVE_TS") for rows in layers]
    )
    return stamps.agg(
        F.to_date(F.min("RECORD_EFFECTIVE_TS")).alias("history_start"),
        F.to_date(F.max("RECORD_EFFECTIVE_TS")).alias("history_end"),
    )

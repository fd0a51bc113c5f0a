"""The common shape of a check's outcome."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.schemas import DISPLAY_CAP

COUNTS = ("source_row_count", "target_row_count", "matched_record_count", "failed_record_count")


@dataclass
class Check:
    """
    A lazy check: one frame, aggregates that measure it, and the failures in it.

    ``metrics`` costs one aggregate over ``frame``. ``failures`` is a projection
    of the same frame, so a passing check never has to produce it.
    """

    frame: DataFrame
    measures: dict[str, Column]  # source_row_count, target_row_count, matched…, failed…
    to_failures: Callable[[DataFrame], DataFrame]
    always_passes: bool = False
    all_fail: bool = False  # each row of ``frame`` is one failure and nothing else is measured
    compared_columns: tuple[str, ...] = ()

    @property
    def failures(self) -> DataFrame:
        return self.to_failures(self.frame)

    @property
    def totals(self) -> list[Column]:
        """The aggregates over ``frame`` that measure it."""
        zero = F.lit(0).cast("bigint")
        return [F.coalesce(self.measures.get(n, zero), zero).cast("bigint").alias(n) for n in COUNTS]

    @property
    def metrics(self) -> DataFrame:
        failed = F.col("failed_record_count") > 0
        status = F.lit("PASS") if self.always_passes else F.when(failed, "FAIL").otherwise("PASS")
        return self.frame.agg(*self.totals).select(
            status.alias("status"),
            *COUNTS,
            (F.col("failed_record_count") > DISPLAY_CAP).alias("truncated"),
        )

    def observed(self, seen: Observation) -> DataFrame:
        """The failures; ``seen`` gets the totals from the same pass, counted where the frame's last stage ends."""
        return self.to_failures(self.frame.observe(seen, *self.totals))

    @staticmethod
    def measured(totals: dict) -> dict:
        """``metrics`` from the totals of a check that can fail."""
        failed = totals["failed_record_count"]
        return {"status": "FAIL" if failed else "PASS", **{n: totals[n] for n in COUNTS}, "truncated": failed > DISPLAY_CAP}

    @staticmethod
    def all_failed(failed: int) -> dict:
        """The totals of a check whose rows all fail, from their number."""
        return dict(zip(COUNTS, (failed, 0, 0, failed)))

    def sample(self, n: int = DISPLAY_CAP) -> DataFrame:
        """The first failures by key, for a report; ``failures`` stays complete."""
        return self.failures.orderBy("business_key", "failure_type", "column_name").limit(n)

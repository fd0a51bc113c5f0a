"""Rerunning saved checks. What a run came to is asked of the run log, never kept beside it."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.plans import history
from plumbline.plans.params import run_clock
from plumbline.plans.rules import Rule
from plumbline.plans.runner import Result, RunLog, in_folder, run_rules, whole_suite

# What started a run.
FROM_HISTORY, FROM_FOLDER, FROM_SUITE = "EXECUTION_HISTORY", "REGRESSION_FOLDER", "FULL_SUITE"


class Started(NamedTuple):
    """The ids under which a run is logged, and what it executed."""

    run_id: str
    regression_id: str
    results: list[Result]


def outcome(log: RunLog, run_id: str) -> DataFrame:
    """Status counts and pass rate of one run; no row when nothing ran under that id."""
    return history.run_summary(log.executions.filter(F.col("run_id") == run_id))


def selection(spark: SparkSession, rules: Iterable[Rule], wanted: Iterable[str]) -> DataFrame:
    """What a list of test ids comes to: see ``history.rerun_selection``."""
    saved = [(r.test_id, r.version, r.active) for r in rules]
    asked = list(enumerate(wanted))
    return history.rerun_selection(
        spark.createDataFrame(asked, "position int, test_case_id string"),
        spark.createDataFrame(saved, "test_case_id string, version_no int, is_active boolean"),
    )


def _launch(
    spark: SparkSession, chosen: list[Rule], tables: Mapping, batch_id: str, log: RunLog,
    trigger: str, mode: str, folder: str = "", window: tuple | None = None,
    project_id: str = "", executed_by: str = "", **more,
) -> Started:
    """Log that a run starts, run it, log that it ended; a run that dies keeps its start."""
    begun = spark.range(1).select(run_clock().alias("t")).first().t
    regression_id = uuid.uuid4().hex
    run_id = f"RUN_{begun:%Y%m%d_%H%M%S}_{regression_id[:6]}"
    moment = F.lit(None).cast("timestamp_ntz")
    low, after = history.window_bounds(*window) if window else (moment, moment)
    start = spark.range(1).select(
        F.lit(regression_id).alias("regression_id"), F.lit(run_id).alias("run_id"),
        F.lit(project_id).alias("project_id"), F.lit(folder).alias("folder_path"),
        F.lit(trigger).alias("triggered_from"),
        F.lit([r.test_id for r in chosen]).cast("array<string>").alias("selected_test_ids"),
        low.alias("history_start"), (after - F.expr("INTERVAL '0.000001' SECOND")).alias("history_end"),
        F.lit(len(chosen)).alias("total_tests"),
        *[F.lit(0).alias(f"{s}_tests") for s in ("passed", "failed", "error")],
        F.lit(str(begun)).cast("timestamp_ntz").alias("started_ts"),
        moment.alias("completed_ts"), F.lit(executed_by).alias("executed_by"),
    )
    log.append("regression_run", _shaped(start), "started_ts")
    results = run_rules(spark, chosen, tables, batch_id, log=log, run_id=run_id, run_mode=mode,
                        project_id=project_id, executed_by=executed_by, **more)
    done = start.join(outcome(log, run_id), "run_id", "left") if results else start
    counts = {"passed_tests": "passed", "failed_tests": "failed", "error_tests": "errored"}
    ended = {k: F.col(v) for k, v in counts.items()} if results else {}
    log.append("regression_run", _shaped(done.withColumns({**ended, "completed_ts": run_clock()})), "started_ts")
    return Started(run_id, regression_id, results)


def _shaped(row: DataFrame) -> DataFrame:
    kinds = schemas.types(schemas.REGRESSION_RUN)
    return row.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])


def rerun(
    spark: SparkSession, rules: Iterable[Rule], wanted: Iterable[str], tables: Mapping,
    batch_id: str, log: RunLog, window: tuple | None = None, **more,
) -> Started:
    """Rerun selected checks once each, at their current definition."""
    rules = list(rules)
    known = {r.test_id: r for r in rules}
    runnable = selection(spark, rules, wanted).filter("skipped IS NULL").orderBy("position")
    chosen = [known[r.test_case_id] for r in runnable.collect()]  # at most one row per saved check
    return _launch(spark, chosen, tables, batch_id, log, FROM_HISTORY, "REGRESSION_RERUN",
                   window=window, **more)


def rerun_failing(
    spark: SparkSession, rules: Iterable[Rule], start, end, tables: Mapping, batch_id: str,
    log: RunLog, project_id: str = "", **more,
) -> Started:
    """Rerun every check whose last run in the window did not pass."""
    failing = history.currently_failing(log.executions, start, end, project_id)
    ids = [r.test_case_id for r in failing.select("test_case_id").orderBy("test_case_id")
           .collect()]  # at most one row per saved check
    return rerun(spark, rules, ids, tables, batch_id, log, (start, end),
                 project_id=project_id, **more)


def run_folder(
    spark: SparkSession, rules: Iterable[Rule], tables: Mapping, batch_id: str, log: RunLog,
    folder: str = "/Regression", **more,
) -> Started:
    chosen = in_folder(rules, folder)
    if not chosen:
        raise LookupError(f"There is no folder '{folder}' with active checks")
    return _launch(spark, chosen, tables, batch_id, log, FROM_FOLDER, "REGRESSION_RERUN", folder,
                   **more)


def run_suite(
    spark: SparkSession, rules: Iterable[Rule], tables: Mapping, batch_id: str, log: RunLog,
    regression_only: bool = False, **more,
) -> Started:
    return _launch(spark, whole_suite(rules, regression_only), tables, batch_id, log, FROM_SUITE,
                   "FULL_SUITE", "(all)", **more)

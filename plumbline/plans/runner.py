"""Run saved checks and log what they found."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from plumbline import schemas
from plumbline.operators import rules as kinds
from plumbline.operators.check import Check
from plumbline.operators.reconcile import match_row_counts, reconcile
from plumbline.plans.params import resolve, run_clock, run_sql
from plumbline.plans.rules import COMPARE, COUNTS, KINDS, NO_ROWS, REPORT, STATUS, Query, Rule
from plumbline.session import tidy_shuffles
from plumbline.sources.tables import SharedTables


@dataclass
class Result:
    """One execution: its measurements, and its failures as a lazy frame."""

    execution_id: str
    rule: Rule
    status: str
    source_row_count: int = 0
    target_row_count: int = 0
    matched_record_count: int = 0
    failed_record_count: int = 0
    truncated: bool = False
    duration_ms: int = 0
    error_message: str = ""
    params: dict | None = None
    check: Check | None = None

    @property
    def failures(self) -> DataFrame | None:
        """Planned only when asked for; None when the check could not be built."""
        return None if self.check is None else self.check.failures


class RunLog:
    """
    Append-only Parquet logs below one folder. Every append gets a folder of its
    own, so checks and runs that log at the same time cannot disturb each other.
    Below it rows lie by day and run: ``run_date`` and ``run_id`` are columns of every log,
    and a filter on them decides which files are read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, name: str, ddl: str) -> DataFrame:
        kinds = {**schemas.types(ddl), "run_date": "date", "run_id": "string"}
        whole = ", ".join(f"{c} {kind}" for c, kind in kinds.items())
        try:
            held = self.spark.read.schema(f"{whole}, append string").parquet(f"{self.root}/{name}")
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            held = self.spark.createDataFrame([], whole)
        return held.select(*kinds)

    @property
    def executions(self) -> DataFrame:
        return self.read("execution_log", schemas.EXECUTION_LOG)

    @property
    def failures(self) -> DataFrame:
        return self.read("failure_log", schemas.FAILURE_LOG)

    @property
    def regression_events(self) -> DataFrame:
        """Start and completion rows; ``history.regression_runs`` folds them."""
        return self.read("regression_run", schemas.REGRESSION_RUN)

    def append(self, name: str, rows: DataFrame, at: str) -> str:
        """Store rows, which have a ``run_id``, under the day of their timestamp ``at``; returns the folder."""
        path = f"{self.root}/{name}/append={uuid.uuid4().hex}"
        rows.withColumn("run_date", F.to_date(at)).write.partitionBy("run_date", "run_id").parquet(
            path, compression="zstd")  # ids of failures are long and random
        return path

    def add_failures(self, results: list[Result], found: DataFrame, run_id: str, batch_id: str, now: datetime) -> int:
        """
        Every failure, whole, under each of the executions that share it, written by the executors; returns how many
        there are for each execution, from the files' footers.
        """
        owners = F.array(*[F.struct(F.lit(r.execution_id).alias("execution_id"), F.lit(r.rule.test_id).alias("test_case_id"))
                           for r in results])
        rows = found.withColumn("owner", F.explode(owners)).select(
            F.uuid().alias("failure_id"),
            "owner.execution_id",
            "owner.test_case_id",
            F.lit(batch_id).alias("batch_id"),
            "business_key",
            "column_name",
            "expected_value",
            "actual_value",
            "failure_type",
            "failure_reason",
            F.lit(str(now)).cast("timestamp_ntz").alias("failed_ts"),
            F.lit(run_id).alias("run_id"),
        )
        path = self.append("failure_log", rows, "failed_ts")
        return self.spark.read.schema(schemas.FAILURE_LOG).parquet(path).count() // len(results)

    def add_executions(
        self, results: list[Result], run_id: str, batch_id: str, now: datetime,
        run_mode: str, project_id: str, executed_by: str,
    ) -> None:
        rows = [
            (r.execution_id, run_id, r.rule.test_id, r.rule.name, project_id, r.rule.folder,
             r.rule.version, batch_id, now, r.status, r.source_row_count, r.target_row_count,
             r.matched_record_count, r.failed_record_count, r.duration_ms, run_mode,
             json.dumps(r.params or {}, default=str), r.error_message, executed_by)
            for r in results
        ]  # one row per check, never per record
        self.append("execution_log", self.spark.createDataFrame(rows, schemas.EXECUTION_LOG)
                    .coalesce(1), "run_ts")


def build(spark: SparkSession, rule: Rule, tables: Mapping, values: Mapping) -> Check:
    """The lazy check of a rule."""
    def frame(query: Query | None, side: str) -> DataFrame:
        if query is None:
            raise ValueError(f"{rule.name}: {side} query is required for {rule.kind}")
        if callable(query):
            return query(tables, values)
        return run_sql(spark, query, values)

    if rule.kind not in KINDS:
        raise ValueError(f"Unknown test type '{rule.kind}' on {rule.test_id or rule.name}")
    if rule.kind in (COMPARE, COUNTS):
        source, target = frame(rule.source, "source"), frame(rule.target, "target")
        if rule.kind == COUNTS:
            return match_row_counts(source, target, rule.tolerance)
        return reconcile(source, target, list(rule.keys), list(rule.compare) or None,
                         rule.tolerance, laid_out=isinstance(tables, SharedTables))
    rows = frame(rule.check, "validation")
    shape = {NO_ROWS: kinds.no_rows, STATUS: kinds.status_column, REPORT: kinds.informational}
    return shape[rule.kind](rows, rule.name)


def run_rules(
    spark: SparkSession,
    rules: Iterable[Rule],
    tables: Mapping,
    batch_id: str,
    params: Mapping | None = None,
    log: RunLog | None = None,
    run_id: str | None = None,
    run_mode: str = "ADHOC",
    project_id: str = "",
    executed_by: str = "",
    parallel: int = 1,
) -> list[Result]:
    """
    Run checks under one run id; results keep the order given. A check that raises,
    while planning or while running, is an ERROR and the rest still run.
    ``parallel`` checks are submitted at a time, so small ones can share a cluster.

    Each check runs once. With a log its failures are written in the pass that measures
    it: counted from what was written where every row is a failure, else observed by the
    stage that writes. Copies of a definition, such as regression copies, share one pass,
    whose outcome and failures are logged for each of them. Rows that several checks match by the same
    key are laid out by it once for the run (``SharedTables``). Without a log measuring is one
    aggregate, and failures are computed when the result's ``failures`` are read, so an
    error in a detail column shows there.
    """
    rules = list(rules)
    now = spark.range(1).select(run_clock().alias("t")).first().t
    run_id = run_id or f"RUN_{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"

    def run(copies: list[int]) -> list[Result]:
        rule = rules[copies[0]]
        values = resolve(batch_id, now, rule.defaults, params)
        found = [Result(uuid.uuid4().hex, rules[i], "ERROR", params=values) for i in copies]
        began, told, check = time.perf_counter(), {}, None
        try:
            built = build(spark, rule, tables, values)
            if log is None or built.always_passes:
                told = built.metrics.first().asDict()  # one row; forces planning and execution
            elif built.all_fail:
                told = built.measured(built.all_failed(
                    log.add_failures(found, built.failures, run_id, batch_id, now)))
            else:
                seen = Observation()
                log.add_failures(found, built.observed(seen), run_id, batch_id, now)
                told = built.measured(seen.get)
            check = built
        except Exception as exc:
            told = {"error_message": f"{type(exc).__name__}: {exc}"}
        told["duration_ms"] = int((time.perf_counter() - began) * 1000)
        for result in found:
            result.check = check
            for name, value in told.items():
                setattr(result, name, value)
        return found

    alike = _alike(rules)  # positions
    shared = SharedTables(spark, tables)
    tables = shared if len(alike) > 1 else tables
    try:
        with tidy_shuffles(spark):
            if parallel > 1:
                with ThreadPoolExecutor(parallel) as pool:
                    done = list(pool.map(inheritable_thread_target(spark)(run), alike))
            else:
                done = [run(copies) for copies in alike]
    finally:
        shared.release()
    placed = {i: result for copies, found in zip(alike, done) for i, result in zip(copies, found)}
    results = [placed[i] for i in range(len(rules))]
    if log is not None and results:
        log.add_executions(results, run_id, batch_id, now, run_mode, project_id, executed_by)
    return results


def _alike(rules: list[Rule]) -> list[list[int]]:
    """Positions of rules by what they check: copies of one definition come together, in the order given."""
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(rules):
        what = (r.name, r.kind, r.source, r.target, r.check, tuple(r.keys), tuple(r.compare), r.tolerance,
                json.dumps(dict(r.defaults), default=str, sort_keys=True))
        groups.setdefault(what, []).append(i)
    return list(groups.values())


def in_folder(rules: Iterable[Rule], folder: str) -> list[Rule]:
    """Active rules of a folder, in id order."""
    return sorted((r for r in rules if r.folder == folder and r.active), key=lambda r: r.test_id)


def whole_suite(rules: Iterable[Rule], regression_only: bool = False) -> list[Rule]:
    """Every active rule, folder by folder."""
    chosen = (r for r in rules if r.active and (r.regression or not regression_only))
    return sorted(chosen, key=lambda r: (r.folder, r.test_id))


def results_frame(spark: SparkSession, results: list[Result]) -> DataFrame:
    rows = [
        (r.rule.test_id, r.status, r.source_row_count, r.target_row_count,
         r.matched_record_count, r.failed_record_count, r.truncated, r.duration_ms,
         r.error_message)
        for r in results
    ]
    return spark.createDataFrame(rows, schemas.METRICS)


def compare_tables(
    source: DataFrame, target: DataFrame, keys: list[str] | None = None,
    compare: list[str] | None = None, batch_id: str | None = None, counts_only: bool = False,
) -> Check:
    """
    A check of one table against another with the usual defaults: the key is the
    first shared ``*_ID`` column, and a batch filter applies to a side that has one.
    """
    if batch_id is not None:
        source, target = (
            side.filter(F.col("BATCH_ID") == batch_id)
            if "BATCH_ID" in {c.upper() for c in side.columns} else side
            for side in (source, target)
        )
    if counts_only:
        return match_row_counts(
            source.agg(F.count(F.lit(1)).alias("n")), target.agg(F.count(F.lit(1)).alias("n"))
        )
    if not keys:
        shared = {c.upper() for c in target.columns}
        keys = [c for c in source.columns
                if c.upper().endswith("_ID") and c.upper() in shared and c.upper() != "BATCH_ID"]
        keys = keys[:1]
    return reconcile(source, target, keys, compare)

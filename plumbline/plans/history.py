"""Questions about past runs, as DataFrames over the logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.latest import latest_by, latest_execution

NOT_GOOD = ("FAIL", "ERROR")


def window_bounds(start, end) -> tuple[Column, Column]:
    """
    A window as (first moment, first moment after it).

    A last day, or a last moment that is a midnight, takes in the whole of that day; any other
    last moment is still inside. As text, so that no time zone takes part.
    """
    low, last = (F.lit(str(x)).cast("timestamp_ntz") for x in (start, end))
    next_day = last + F.expr("INTERVAL 1 DAY")
    just_after = last + F.expr("INTERVAL '0.000001' SECOND")
    return low, F.when(last == F.date_trunc("day", last).cast("timestamp_ntz"), next_day).otherwise(just_after)


def in_window(ts: Column, start, end) -> Column:
    low, after = window_bounds(start, end)
    return (ts >= low) & (ts < after)


def in_folder(path: Column, folder: str) -> Column:
    """The folder itself or anything below it; '/Reg' does not match '/Regression'."""
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/")


def executions_in(
    log: DataFrame, start, end, project: str = "", folder: str = "", status: str = "",
    test: str = "", latest_per_test: bool = False,
) -> DataFrame:
    """
    Executions between two days, inclusive. ``latest_per_test`` ranks after the
    other filters, so with a status it means "the latest such run".
    """
    rows = log.filter(in_window(F.col("run_ts"), start, end))
    if "run_date" in log.columns:  # a log that lies by day: other days are not read
        low, after = window_bounds(start, end)
        rows = rows.filter(F.col("run_date").between(F.to_date(low), F.to_date(after)))
    if project:
        rows = rows.filter(F.col("project_id") == project)
    if folder:
        rows = rows.filter(in_folder(F.col("folder_path"), folder))
    if status:
        rows = rows.filter(F.col("status") == status)
    if test:
        rows = rows.filter(F.col("test_case_id") == test)
    return latest_execution(rows) if latest_per_test else rows


def execution_history(
    log: DataFrame, start, end, limit: int | None = None, **filters
) -> DataFrame:
    """Executions newest first; a page passes how many it shows."""
    newest = [F.col("run_ts").desc_nulls_last(), F.col("execution_id").asc()]
    rows = executions_in(log, start, end, **filters).orderBy(*newest)
    return rows if limit is None else rows.limit(limit)


def currently_failing(log: DataFrame, start, end, project: str = "") -> DataFrame:
    """Tests whose most recent run in the window did not pass."""
    latest = executions_in(log, start, end, project=project, latest_per_test=True)
    return latest.filter(F.col("status").isin(*NOT_GOOD))


def failure_detail(
    failures: DataFrame, log: DataFrame | None = None, execution: str = "", test: str = "",
    run: str = "", limit: int | None = None,
) -> DataFrame:
    """Failure rows of an execution, a test or a run; a log that lies by run is read for that run only."""
    rows = failures
    if execution:
        rows = rows.filter(F.col("execution_id") == execution)
    if test:
        rows = rows.filter(F.col("test_case_id") == test)
    if run and "run_id" in rows.columns:
        rows = rows.filter(F.col("run_id") == run)
    elif run:
        of_run = log.filter(F.col("run_id") == run).select("execution_id")
        rows = rows.join(of_run, "execution_id", "left_semi")
    if limit is None:
        return rows
    return rows.orderBy(F.col("failed_ts").desc(), "business_key", "failure_id").limit(limit)


def latest_failures(failures: DataFrame, log: DataFrame, project: str = "") -> DataFrame:
    """Failure rows of each test's most recent run only."""
    runs = log.filter(F.col("project_id") == project) if project else log
    return failures.join(latest_execution(runs).select("execution_id"), "execution_id",
                         "left_semi")


def pass_pct(passed: Column, total: Column) -> Column:
    """Percentage with one decimal, half up; NULL when nothing ran."""
    return F.when(total > 0, F.floor((passed * 2000 + total) / (total * 2)) / 10)


def _tallies() -> list[Column]:
    return [
        F.count_if(F.col("status").isin("PASS", *NOT_GOOD)).alias("total"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "ERROR").alias("errored"),
    ]


def dashboard_summary(log: DataFrame, project: str = "") -> DataFrame:
    """One row: status counts and failed records over each test's latest run."""
    runs = log.filter(F.col("project_id") == project) if project else log
    return (
        latest_execution(runs)
        .agg(*_tallies(),
             F.coalesce(F.sum("failed_record_count"), F.lit(0)).alias("failed_records"))
        .withColumn("pass_pct", pass_pct(F.col("passed"), F.col("total")))
    )


def run_summary(log: DataFrame) -> DataFrame:
    """Status counts and pass rate per run."""
    return log.groupBy("run_id").agg(*_tallies()).withColumn(
        "pass_pct", pass_pct(F.col("passed"), F.col("total"))
    )


def status_by_folder(log: DataFrame) -> DataFrame:
    return latest_execution(log).groupBy("folder_path", "status").agg(
        F.count(F.lit(1)).alias("tests")
    )


def runs_per_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("run_ts").alias("day"), "status").agg(
        F.count(F.lit(1)).alias("executions")
    )


def pass_rate_per_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("run_ts").alias("day")).agg(
        F.avg((F.col("status") == "PASS").cast("double")).alias("rate"),
        F.count(F.lit(1)).alias("runs"),
    )


def top_failures(failures: DataFrame, by: str, top: int = 8) -> DataFrame:
    """The fields with most failures; ties go to the smaller name."""
    return (
        failures.groupBy(F.coalesce(F.col(by), F.lit("(none)")).alias(by))
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.col("records").desc(), by).limit(top)
    )


# ---------------------------------------------------------------- reruns
def rerun_selection(selected: DataFrame, catalog: DataFrame) -> DataFrame:
    """
    Tests to run again: each selected id once, at its first position, with the
    catalog's current version; ``skipped`` says why one will not run.
    """
    first = selected.filter(F.coalesce("test_case_id", F.lit("")) != "").groupBy(
        "test_case_id"
    ).agg(F.min("position").alias("position"))
    current = catalog.select(
        "test_case_id", "version_no", "is_active", F.lit(True).alias("_known")
    )
    return first.join(current, "test_case_id", "left").select(
        "position", "test_case_id", "version_no",
        F.when(F.col("_known").isNull(), "could not be loaded")
        .when(~F.col("is_active"), "test case is inactive (deleted)").alias("skipped"),
    )


def edited_since_run(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tests whose saved version differs from the one last run, as v1 -> v2."""
    last = log.groupBy("test_case_id").agg(
        F.max_by("test_version_no", F.struct("run_ts", "execution_id")).alias("ran")
    )
    return catalog.select("test_case_id", "version_no").join(last, "test_case_id").filter(
        F.col("ran") != F.col("version_no")
    ).select(
        "test_case_id",
        F.format_string("v%s→v%s", F.col("ran").cast("string"),
                        F.col("version_no").cast("string")).alias("change"),
    )


def with_last_result(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """Every saved test with its most recent status and time, if it ever ran."""
    last = latest_execution(log).select(
        "test_case_id", F.col("status").alias("last_status"), F.col("run_ts").alias("last_run_ts")
    )
    return catalog.join(last, "test_case_id", "left")


def folder_tree(folders: DataFrame, tests: DataFrame) -> DataFrame:
    """Active folders with the number of active tests in each."""
    counted = tests.filter("is_active").groupBy("folder_id").agg(
        F.count(F.lit(1)).alias("test_count")
    )
    return folders.filter("is_active").join(counted, "folder_id", "left").select(
        *folders.columns, F.coalesce("test_count", F.lit(0)).alias("test_count")
    )


def regression_runs(events: DataFrame, log: DataFrame, limit: int | None = None) -> DataFrame:
    """Start rows with the outcome of what ran under their run id, newest first."""
    done = run_summary(log).join(
        log.groupBy("run_id").agg(F.max("run_ts").alias("last_ts")), "run_id"
    )
    started = latest_by(events, ["regression_id"], [F.col("completed_ts").desc_nulls_last()])
    rows = (
        started.drop("total_tests", "passed_tests", "failed_tests", "error_tests")
        .join(done, "run_id", "left")
        .orderBy(F.col("started_ts").desc(), "regression_id")
    )
    return rows if limit is None else rows.limit(limit)

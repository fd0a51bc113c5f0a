"""Run history, dashboards, rerun selection and the rule catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.latest import latest_execution
from plumbline.plans import catalog as cat
from plumbline.plans import history
from plumbline.plans.params import missing_params, required_params, resolve_column
from plumbline.plans.runner import RunLog
from plumbline.session import scratch
from plumbline.workload import sql
from plumbline.workload.feed import Feed

START, END = "2024-01-10", "2024-01-20"


def rerun(feed: Feed) -> DataFrame:
    """Everything that failed is selected again, several times; the catalog decides what runs."""
    selected = feed.run_log.filter(F.col("status") != "PASS").select(
        "test_case_id", F.substring("execution_id", 2, 12).cast("bigint").alias("position"))
    return history.rerun_selection(selected, feed.catalog)


def stored_log(feed: Feed) -> RunLog:
    """The runs and their failures as a log on disk."""
    log = RunLog(feed.spark, scratch(feed.spark, "run-log"))
    log.append("execution_log", feed.run_log.repartition("run_id"), "run_ts")
    owner = feed.run_log.select("execution_id", "run_id")
    log.append("failure_log", feed.failure_log.join(owner, "execution_id").repartition("run_id"), "failed_ts")
    return log


def stored_failures(feed: Feed) -> DataFrame:
    """One run's failures out of a log that lies by day and run."""
    log = stored_log(feed)
    return history.failure_detail(log.failures, log.executions, run="RUN_20240115").select(feed.failure_log.columns)


def stored_window(feed: Feed) -> DataFrame:
    """The executions of some days out of a log that lies by day and run."""
    return history.executions_in(stored_log(feed).executions, START, END, project="PRJ-1").select(feed.run_log.columns)


def folders(feed: Feed) -> DataFrame:
    """One folder per brand that any part has."""
    return feed.table("part").groupBy(F.col("p_brand").alias("folder_id")).agg(
        (F.max("p_size") > 0).alias("is_active"))


def required(feed: Feed) -> DataFrame:
    return required_params(feed.catalog).select(
        "test_case_id", F.array_join("required", ",").alias("required"))


def unbound(feed: Feed) -> DataFrame:
    """Parameters each check still lacks, given built-ins, saved defaults and overrides."""
    given = resolve_column(
        F.lit("BATCH_1996"),
        F.create_map(F.lit("run_date"), F.lit("2024-01-01"), F.lit("batch_id"), F.lit("saved")),
        F.create_map(F.lit("size_10"), F.lit("10"), F.lit("batch_id"),
                     F.lit(None).cast("string"), F.lit("run_date"), F.lit("2024-02-02")),
    )
    needs = required_params(feed.catalog)
    return needs.select(
        "test_case_id",
        F.array_join(missing_params(F.col("required"), given), ",").alias("missing"),
        given["batch_id"].alias("batch_id"), given["run_date"].alias("run_date"),
    )


def edits(feed: Feed) -> DataFrame:
    """A version log: each event of a user is an edit of that user's check."""
    return feed.table("events").select(
        F.format_string("V%012d", "event_id").alias("version_id"),
        F.format_string("TC-%04d", "user_id").alias("test_case_id"),
        F.dayofmonth("ts").alias("version_no"),
        F.col("props").alias("snapshot_json"),
        F.col("event_type").alias("change_note"),
        F.concat(F.lit("user"), "user_id").alias("changed_by"),
        F.col("ts").alias("changed_ts"),
    )


def save_edits(feed: Feed) -> DataFrame:
    """Renaming the checks of one brand: the log gains two snapshots per edited check."""
    catalog = feed.catalog
    renamed = catalog.filter(F.col("folder_id") == "Brand#7").withColumn(
        "test_name", F.concat("test_name", F.lit(" v2")))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    current, log = cat.save(catalog, renamed, "qa", now)
    after = current.select("test_case_id", "version_no", "test_name", F.lit("").alias("note"))
    logged = log.select(
        "test_case_id", "version_no",
        F.get_json_object("snapshot_json", "$.test_name").alias("test_name"),
        F.col("change_note").alias("note"))
    return after.unionByName(logged)


def seeded(feed: Feed) -> DataFrame:
    """Seeding the active checks over the whole catalog, matched by folder and name."""
    base = feed.catalog.groupBy("folder_id", F.lower("test_name").alias("test_name")).agg(
        F.min("version_no").alias("version_no"))
    wanted = feed.catalog.filter("is_active").groupBy(
        F.when(F.col("severity") == "Medium", F.col("folder_id")).alias("folder_id"),
        F.upper(F.concat("test_name", F.when(F.col("folder_id") == "Brand#3", "!").otherwise("")))
        .alias("test_name")).agg(F.min("version_no").alias("version_no"))
    return cat.seed(base, wanted).withColumn("test_name", F.upper("test_name"))


def copies(feed: Feed) -> DataFrame:
    return cat.copy_into(feed.catalog, ["red widget", "blue bolt"], "Regression").groupBy(
        "test_name", "folder_id", "version_no").agg(F.count(F.lit(1)).alias("n"))


def regression_events(feed: Feed) -> DataFrame:
    """A start row per run of the log."""
    return feed.run_log.groupBy("run_id").agg(
        F.min("run_ts").alias("started_ts"),
        F.count_distinct("test_case_id").alias("total_tests"),
    ).select(
        F.concat(F.lit("REG_"), "run_id").alias("regression_id"), "run_id",
        F.lit("CLI").alias("triggered_from"), "total_tests",
        F.lit(0).alias("passed_tests"), F.lit(0).alias("failed_tests"),
        F.lit(0).alias("error_tests"), "started_ts",
        F.lit(None).cast("timestamp_ntz").alias("completed_ts"),
    )


_LOG = ("execution_id, run_id, test_case_id, test_name, project_id, folder_path, "
        "test_version_no, run_ts, status, failed_record_count")
_WINDOW = "run_ts >= TIMESTAMP '2024-01-10' AND run_ts < TIMESTAMP '2024-01-21'"
_REG = "(folder_path = '/Regression' OR folder_path LIKE '/Regression/%')"
_PCT = "CAST((passed * 2000 + total) // (total * 2) AS DOUBLE) / 10"
_TALLY = ("count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, "
          "count(*) FILTER (WHERE status = 'FAIL') AS failed, "
          "count(*) FILTER (WHERE status = 'ERROR') AS errored")


def _latest(rows: str) -> str:
    return (f"SELECT {_LOG} FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY test_case_id "
            "ORDER BY run_ts DESC, execution_id) = 1")


def _required_sql() -> str:
    """Which names each check's text contains, written from how the text is made."""
    query = "'size_' || p_size || ',' || lower(p_type) || ',batch_id'"
    return ("SELECT test_case_id, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN "
            f"{query} || CASE WHEN p_size <> 9 THEN ',run_date' ELSE '' END ELSE {query} END "
            "AS required FROM catalog")


_EDITS = ("SELECT format('V{:012d}', event_id) AS version_id, format('TC-{:04d}', user_id) AS "
          "test_case_id, CAST(day(ts) AS INTEGER) AS version_no, props AS snapshot_json, "
          "event_type AS change_note, 'user' || user_id AS changed_by, ts AS changed_ts "
          "FROM events")
_SNAPSHOTS = ("SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY test_case_id, "
              "version_no ORDER BY changed_ts DESC, version_id DESC) = 1")


def _lint_sql() -> str:
    kinds = ("SOURCE_TARGET_COMPARE, SQL_ROWCOUNT, ROW_COUNT_MATCH, STATUS_COLUMN, INFORMATIONAL")
    cases = [
        ("p_size = 7", "Test name is required."),
        ("p_type = 'MEDIUM'", f"Test type must be one of: {kinds}"),
        ("p_type IN ('ECONOMY', 'STANDARD') AND p_size = 9",
         "Target SQL is required for this test type."),
        ("p_type = 'ECONOMY' AND p_size >= 45",
         "Key column(s) are required to match source rows to target rows."),
    ]
    return sql.using("catalog", " UNION ALL ".join(
        f"SELECT test_case_id, '{text}' AS problem FROM catalog WHERE {w}" for w, text in cases))


def queries() -> dict:
    from plumbline.plans.rules import KINDS

    assert len(KINDS) == 5
    return {
        "latest_execution": (lambda f: latest_execution(f.run_log), sql.using(
            "latest_run", f"SELECT {_LOG} FROM latest_run")),
        "execution_history": (
            lambda f: history.execution_history(f.run_log, START, END, limit=5000, folder="/Regression"),
            sql.using("run_log", f"SELECT {_LOG} FROM run_log WHERE {_WINDOW} AND {_REG} "
                      "ORDER BY run_ts DESC, execution_id LIMIT 5000")),
        "history_window": (
            lambda f: history.executions_in(f.run_log, START, END, project="PRJ-1",
                                            status="FAIL"),
            sql.using("run_log", f"SELECT {_LOG} FROM run_log WHERE {_WINDOW} AND "
                      "project_id = 'PRJ-1' AND status = 'FAIL'")),
        "latest_failing_run": (
            lambda f: history.executions_in(f.run_log, START, END, status="FAIL",
                                            latest_per_test=True),
            sql.using("run_log", _latest(f"SELECT * FROM run_log WHERE {_WINDOW} "
                                         "AND status = 'FAIL'"))),
        "failing_in_window": (
            lambda f: history.currently_failing(f.run_log, START, END, project="PRJ-1"),
            sql.using("run_log", "SELECT * FROM (" + _latest(
                f"SELECT * FROM run_log WHERE {_WINDOW} AND project_id = 'PRJ-1'")
                + ") WHERE status IN ('FAIL', 'ERROR')")),
        "failures_of_run": (
            lambda f: history.failure_detail(f.failure_log, f.run_log, run="RUN_20240115",
                                             limit=None),
            sql.using("failure_log", "SELECT * FROM failure_log WHERE failed_ts >= TIMESTAMP "
                      "'2024-01-15' AND failed_ts < TIMESTAMP '2024-01-16'")),
        "stored_failures_of_run": (stored_failures, sql.using(
            "failure_log", "SELECT * FROM failure_log WHERE failed_ts >= TIMESTAMP "
            "'2024-01-15' AND failed_ts < TIMESTAMP '2024-01-16'")),
        "stored_history_window": (stored_window, sql.using(
            "run_log", f"SELECT * FROM run_log WHERE {_WINDOW} AND project_id = 'PRJ-1'")),
        "failure_page": (
            lambda f: history.failure_detail(f.failure_log, limit=2000),
            sql.using("failure_log", "SELECT * FROM failure_log ORDER BY failed_ts DESC, "
                      "business_key, failure_id LIMIT 2000")),
        "latest_failures": (
            lambda f: history.latest_failures(f.failure_log, f.run_log, "PRJ-1"),
            sql.using("failure_log latest_run", "SELECT f.* FROM failure_log f JOIN latest_run l "
                      "ON l.execution_id = f.execution_id WHERE l.project_id = 'PRJ-1'")),
        "dashboard_summary": (
            lambda f: history.dashboard_summary(f.run_log),
            sql.using("latest_run", f"SELECT *, {_PCT} AS pass_pct FROM (SELECT {_TALLY}, "
                      "CAST(sum(failed_record_count) AS BIGINT) AS failed_records "
                      "FROM latest_run)")),
        "run_summary": (
            lambda f: history.run_summary(f.run_log),
            sql.using("run_log", f"SELECT *, {_PCT} AS pass_pct FROM (SELECT run_id, {_TALLY} "
                      "FROM run_log GROUP BY run_id)")),
        "regression_runs": (
            lambda f: history.regression_runs(regression_events(f), f.run_log, limit=50).select(
                "regression_id", "started_ts", "total", "passed", "failed", "errored",
                "pass_pct", "last_ts"),
            sql.using("run_log", "SELECT 'REG_' || run_id AS regression_id, started_ts, total, "
                      f"passed, failed, errored, {_PCT} AS pass_pct, last_ts FROM (SELECT run_id, "
                      f"min(run_ts) AS started_ts, max(run_ts) AS last_ts, {_TALLY} FROM run_log "
                      "GROUP BY run_id) ORDER BY started_ts DESC LIMIT 50")),
        "status_by_folder": (
            lambda f: history.status_by_folder(f.run_log),
            sql.using("latest_run", "SELECT folder_path, status, count(*) AS tests "
                      "FROM latest_run GROUP BY ALL")),
        "runs_per_day": (
            lambda f: history.runs_per_day(f.run_log),
            sql.using("run_log", "SELECT CAST(run_ts AS DATE) AS day, status, count(*) AS "
                      "executions FROM run_log GROUP BY ALL")),
        "pass_rate_per_day": (
            lambda f: history.pass_rate_per_day(f.run_log),
            sql.using("run_log", "SELECT CAST(run_ts AS DATE) AS day, avg(CASE WHEN status = "
                      "'PASS' THEN 1.0::DOUBLE ELSE 0 END) AS rate, count(*) AS runs "
                      "FROM run_log GROUP BY ALL")),
        "top_failures_by_column": (
            lambda f: history.top_failures(f.failure_log, "column_name"),
            sql.using("failure_log", "SELECT coalesce(column_name, '(none)') AS column_name, "
                      "count(*) AS records FROM failure_log GROUP BY 1 ORDER BY 2 DESC, 1 "
                      "LIMIT 8")),
        "top_failures_by_test": (
            lambda f: history.top_failures(f.failure_log, "test_case_id"),
            sql.using("failure_log", "SELECT test_case_id, count(*) AS records FROM failure_log "
                      "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")),
        "rerun_selection": (rerun, sql.using("run_log catalog", (
            "SELECT min(CAST(substr(execution_id, 2) AS BIGINT)) AS position, r.test_case_id, "
            "any_value(c.version_no) AS version_no, CASE WHEN any_value(c.test_case_id) IS NULL "
            "THEN 'could not be loaded' WHEN NOT any_value(c.is_active) THEN 'test case is "
            "inactive (deleted)' END AS skipped FROM run_log r LEFT JOIN catalog c ON "
            "c.test_case_id = r.test_case_id WHERE r.status <> 'PASS' GROUP BY r.test_case_id"))),
        "edited_since_run": (
            lambda f: history.edited_since_run(f.run_log, f.catalog),
            sql.using("run_log catalog", "SELECT c.test_case_id, 'v' || r.test_version_no || '→v' "
                      "|| c.version_no AS change FROM catalog c JOIN (SELECT * FROM run_log "
                      "QUALIFY row_number() OVER (PARTITION BY test_case_id ORDER BY run_ts DESC, "
                      "execution_id DESC) = 1) r ON r.test_case_id = c.test_case_id "
                      "WHERE r.test_version_no <> c.version_no")),
        "last_results": (
            lambda f: history.with_last_result(
                f.catalog.select("test_case_id", "test_name"), f.run_log),
            sql.using("catalog latest_run", "SELECT c.test_case_id, c.test_name, l.status AS "
                      "last_status, l.run_ts AS last_run_ts FROM catalog c LEFT JOIN latest_run l "
                      "ON l.test_case_id = c.test_case_id")),
        "folder_tree": (
            lambda f: history.folder_tree(folders(f), f.catalog),
            sql.using("catalog", "SELECT folder_id, true AS is_active, count(*) FILTER (WHERE "
                      "is_active) AS test_count FROM catalog GROUP BY folder_id")),
        "name_clashes": (
            lambda f: cat.name_clashes(f.catalog, ["folder_id"], "test_name"),
            sql.using("catalog", "SELECT folder_id, upper(test_name) AS name_key, count(*) AS "
                      "n_rows FROM catalog WHERE is_active GROUP BY ALL HAVING count(*) > 1")),
        "name_clashes_reserved": (
            lambda f: cat.name_clashes(f.catalog, ["folder_id"], "test_name", reserved=True),
            sql.using("catalog", "SELECT folder_id, upper(test_name) AS name_key, count(*) AS "
                      "n_rows FROM catalog GROUP BY ALL HAVING count(*) > 1")),
        "definition_lint": (lambda f: cat.lint(f.catalog), _lint_sql()),
        "required_params": (required, sql.using("catalog", _required_sql())),
        "missing_params": (unbound, sql.using("catalog", (
            "SELECT test_case_id, CASE WHEN p_size = 10 THEN '' ELSE 'size_' || p_size || ',' END "
            "|| lower(p_type) AS missing, 'saved' AS batch_id, '2024-02-02' AS run_date "
            "FROM catalog"))),
        "version_log": (
            lambda f: cat.version_log(edits(f)),
            f"WITH edits AS ({_EDITS}) SELECT test_case_id, version_no, change_note, changed_by, "
            "changed_ts FROM edits"),
        "latest_snapshots": (
            lambda f: cat.latest_snapshots(edits(f)),
            f"WITH edits AS ({_EDITS}) {_SNAPSHOTS}"),
        "version_restore": (
            lambda f: cat.restored(edits(f), 3),
            f"WITH edits AS ({_EDITS}), latest AS ({_SNAPSHOTS}) SELECT test_case_id, "
            "CAST((SELECT max(version_no) FROM edits e WHERE e.test_case_id = l.test_case_id) + 1 "
            "AS INTEGER) AS version_no, snapshot_json, 'Restored from v3' AS change_note "
            "FROM latest l WHERE version_no = 3"),
        "save_edits": (save_edits, sql.using("catalog", (
            "SELECT test_case_id, CAST(version_no + e AS INTEGER) AS version_no, test_name || "
            "CASE WHEN e = 1 THEN ' v2' ELSE '' END AS test_name, '' AS note FROM (SELECT *, CASE "
            "WHEN folder_id = 'Brand#7' THEN 1 ELSE 0 END AS e FROM catalog) UNION ALL SELECT "
            "test_case_id, version_no, test_name, 'Superseded by v' || (version_no + 1) FROM "
            "catalog WHERE folder_id = 'Brand#7' UNION ALL SELECT test_case_id, "
            "CAST(version_no + 1 AS INTEGER), test_name || ' v2', 'Edited' FROM catalog "
            "WHERE folder_id = 'Brand#7'"))),
        "catalog_seed": (seeded, sql.using("catalog", (
            "SELECT coalesce(b.folder_id, a.folder_id) AS folder_id, coalesce(b.test_name, "
            "a.test_name) AS test_name, CASE WHEN a.test_name IS NULL THEN 'created' WHEN "
            "b.test_name IS NULL THEN 'kept' ELSE 'updated' END AS action FROM base a FULL JOIN "
            "wanted b ON a.folder_id = b.folder_id AND a.test_name = b.test_name"),
            base="SELECT DISTINCT folder_id, upper(test_name) AS test_name FROM catalog",
            wanted="SELECT DISTINCT folder_id, upper(test_name) || CASE WHEN folder_id = "
                   "'Brand#3' THEN '!' ELSE '' END AS test_name FROM catalog WHERE is_active")),
        "catalog_copies": (copies, sql.using("catalog", (
            "SELECT test_name, 'Regression' AS folder_id, 1 AS version_no, count(*) AS n "
            "FROM catalog WHERE test_name IN ('red widget', 'blue bolt') GROUP BY test_name"))),
    }

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators.latest import latest_execution, latest_version
from plumbline.plans import catalog as cat
from plumbline.plans import history


@pytest.fixture
def log(spark):
    def run(eid, test, ts, status, folder="/Regression", failed=0, run="R1", version=1, project="P"):
        return (eid, run, test, f"name {test}", project, folder, version, "B", ts, status, 0, 0, 0,
                failed, 1, "ADHOC", "{}", "", "qa")

    d = datetime
    rows = [
        run("e1", "T1", d(2026, 9, 1, 10), "FAIL", failed=3),
        run("e2", "T1", d(2026, 9, 2, 10), "PASS", run="R2", version=2),
        run("e3", "T2", d(2026, 9, 1, 23, 59), "PASS"),
        run("e4", "T2", d(2026, 9, 2, 0, 0), "ERROR", run="R2"),
        run("e5", "T3", d(2026, 9, 2, 9), "FAIL", "/Regression/Deep", failed=1, run="R2"),
        run("e6", "T4", d(2026, 9, 2, 9), "FAIL", "/Regression_Old", run="R2", project="Q"),
        run("e7", "T4", d(2026, 9, 2, 9), "PASS", "/Regression_Old", run="R2", project="Q"),
    ]
    return spark.createDataFrame(rows, schemas.EXECUTION_LOG)


def ids(df, column="execution_id"):
    return sorted(r[column] for r in df.collect())


@pytest.mark.parametrize("end,inside,outside", [
    ("2026-09-01", "2026-09-01 23:59:59.999999", "2026-09-02"),
    (datetime(2026, 9, 1), "2026-09-01 23:59:59.999999", "2026-09-02"),
    (date(2026, 9, 1), "2026-09-01", "2026-08-31 23:59:59.999999"),
    (datetime(2026, 9, 1, 8), "2026-09-01 08:00:00", "2026-09-01 08:00:00.000001"),
])
def test_last_day_is_whole_and_last_moment_inside(spark, end, inside, outside):
    def holds(moment):
        ts = F.lit(moment).cast("timestamp_ntz")
        return spark.range(1).select(history.in_window(ts, date(2026, 9, 1), end)).first()[0]

    assert holds(inside) and not holds(outside)


def test_filters(log):
    window = ("2026-09-01", "2026-09-02")
    assert ids(history.execution_history(log, "2026-09-01", "2026-09-01")) == ["e1", "e3"]
    assert ids(history.executions_in(log, *window, folder="/Regression/")) == [
        "e1", "e2", "e3", "e4", "e5"]
    assert ids(history.executions_in(log, *window, project="Q", test="T4")) == ["e6", "e7"]
    newest = history.execution_history(log, *window, limit=2).collect()
    assert [r.execution_id for r in newest] == ["e2", "e5"]
    assert ids(history.executions_in(log, *window, status="FAIL", latest_per_test=True)) == [
        "e1", "e5", "e6"]
    assert ids(history.currently_failing(log, *window, project="P"), "test_case_id") == [
        "T2", "T3"]
    assert ids(latest_execution(log)) == ["e2", "e4", "e5", "e6"]      # ties: smaller id


def test_latest_uses_a_group_limit_before_the_shuffle(log):
    plan = latest_execution(log.repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_summaries(log, rows):
    s = history.dashboard_summary(log).first()
    assert (s.total, s.passed, s.failed, s.errored, s.failed_records, s.pass_pct) == (
        4, 1, 2, 1, 1, 25.0)
    assert history.dashboard_summary(log.limit(0)).first().pass_pct is None
    runs = {r.run_id: (r.total, r.passed, r.pass_pct)
            for r in history.run_summary(log).collect()}
    assert runs == {"R1": (2, 1, 50.0), "R2": (5, 2, 40.0)}
    rate = {str(r.day): (r.rate, r.runs) for r in history.pass_rate_per_day(log).collect()}
    assert rate == {"2026-09-01": (0.5, 2), "2026-09-02": (0.4, 5)}
    assert rows(history.status_by_folder(log))[0] == ("/Regression", "ERROR", 1)
    assert history.runs_per_day(log).count() == 5


def test_failures(spark, log):
    t = datetime(2026, 9, 2)
    failures = spark.createDataFrame(
        [("f1", "e1", "T1", "B", "k", "PREMIUM_AMOUNT", "", "", "X", "", t),
         ("f2", "e5", "T3", "B", "k", "PREMIUM_AMOUNT", "", "", "X", "", t),
         ("f3", "e5", "T3", "B", "j", "PREMIUM_AMOUNT", "", "", "X", "", t),
         ("f4", "e5", "T3", "B", "k", None, "", "", "X", "", t)], schemas.FAILURE_LOG)
    assert ids(history.latest_failures(failures, log), "failure_id") == ["f2", "f3", "f4"]
    assert ids(history.failure_detail(failures, log, run="R1"), "failure_id") == ["f1"]
    assert ids(history.failure_detail(failures, execution="e5"), "failure_id") == [
        "f2", "f3", "f4"]
    assert history.failure_detail(failures, test="T3", limit=1).first().failure_id == "f3"
    top = [tuple(r) for r in history.top_failures(failures, "column_name").collect()]
    assert top == [("PREMIUM_AMOUNT", 3), ("(none)", 1)]


def test_rerun_selection_and_edits(spark, log):
    catalog = spark.createDataFrame([("T1", 3, True), ("T2", 1, False), ("T3", 1, True)],
                                    "test_case_id string, version_no int, is_active boolean")
    selected = spark.createDataFrame(
        [("T3", 1), ("T1", 2), ("T3", 3), ("T9", 4), ("T2", 5), (None, 6)],
        "test_case_id string, position int")
    got = [tuple(r) for r in history.rerun_selection(selected, catalog).orderBy("position")
           .collect()]
    assert got == [(1, "T3", 1, None), (2, "T1", 3, None), (4, "T9", None, "could not be loaded"),
                   (5, "T2", 1, "test case is inactive (deleted)")]
    assert [tuple(r) for r in history.edited_since_run(log, catalog).collect()] == [
        ("T1", "v2→v3")]
    last = {r.test_case_id: r.last_status
            for r in history.with_last_result(catalog, log).collect()}
    assert last == {"T1": "PASS", "T2": "ERROR", "T3": "FAIL"}


def test_regression_runs(spark, log):
    starts = spark.createDataFrame(
        [("g1", "R1", "P", "/", "CLI", ["T1"], None, None, 2, 0, 0, 0,
          datetime(2026, 9, 1), None, "qa"),
         ("g2", "R2", "P", "/", "CLI", ["T1"], None, None, 5, 0, 0, 0,
          datetime(2026, 9, 2), None, "qa")], schemas.REGRESSION_RUN)
    got = [(r.regression_id, r.passed, r.failed) for r in
           history.regression_runs(starts, log).collect()]
    assert got == [("g2", 2, 2), ("g1", 1, 1)]


def test_latest_version_ranks_before_the_window(spark):
    versions = spark.createDataFrame(
        [("P1", datetime(2026, 9, 18), "B2", 1), ("P1", datetime(2026, 9, 10), "B3", 2),
         ("P2", datetime(2026, 9, 10), "B2", 3), ("P2", datetime(2026, 9, 10), "B3", 4),
         ("P3", None, "B1", 5)],
        "POLICY_ID string, RECORD_EFFECTIVE_TS timestamp_ntz, BATCH_ID string, v int")
    assert ids(latest_version(versions, "POLICY_ID"), "v") == [1, 4, 5]


# ---------------------------------------------------------------- catalog
DDL = ("test_case_id string, test_name string, test_type string, folder_id string, "
       "severity string, source_sql string, target_sql string, validation_sql string, "
       "key_columns string, compare_columns string, tolerance double, is_active boolean, "
       "version_no int")


def rule(i, name="A", kind="SQL_ROWCOUNT", check="SELECT 1", source=None, target=None, keys=None,
         folder="F", active=True, version=1):
    return (i, name, kind, folder, "High", source, target, check, keys, None, 0.0, active, version)


def test_lint(spark):
    df = spark.createDataFrame([
        rule("ok"), rule("noname", " "), rule("kind", kind="ODD"),
        rule("empty", check=" "), rule("pair", kind="SOURCE_TARGET_COMPARE", check=None, keys=" ,"),
        rule("count", kind="ROW_COUNT_MATCH", check=None, source="s", target="t"),
    ], DDL)
    got = {}
    for r in cat.lint(df).collect():
        got.setdefault(r.test_case_id, []).append(r.problem.split(" ")[0])
    assert got == {"noname": ["Test"], "kind": ["Test"], "empty": ["Validation"],
                   "pair": ["Source", "Target", "Key"]}


def test_names_seeding_and_copies(spark):
    df = spark.createDataFrame([
        rule("1", "Check"), rule("2", "CHECK"), rule("3", "check", folder="G"),
        rule("4", "Old", active=False), rule("5", "old")], DDL)
    assert [tuple(r) for r in cat.name_clashes(df, ["folder_id"], "test_name").collect()] == [
        ("F", "CHECK", 2)]
    assert cat.name_clashes(df, ["folder_id"], "test_name", reserved=True).count() == 2
    wanted = spark.createDataFrame([rule(None, "old"), rule(None, "New")], DDL)
    base = df.filter("test_case_id IN ('1', '5')")
    again = {(r.test_name, r.action) for r in cat.seed(base, wanted).collect()}
    assert again == {("old", "updated"), ("New", "created"), ("Check", "kept")}
    assert cat.copy_into(df, ["Check"], "R").first().folder_id == "R"


def test_versions_and_restore(spark):
    now = F.lit("2026-09-01 10:00:00").cast("timestamp_ntz")
    later = F.lit("2026-09-01 11:00:00").cast("timestamp_ntz")
    v1 = spark.createDataFrame([rule("1", "First"), rule("2", "Other")], DDL)
    log = cat.archive(v1.filter("test_case_id = '1'"), "Created", "qa", now)
    edit = v1.filter("test_case_id = '1'").withColumn("test_name", F.lit("Second"))
    v2, more = cat.save(v1, edit, "qa", later)
    log = log.unionByName(more)
    assert sorted(r.version_no for r in log.collect()) == [1, 1, 2]
    assert [r.version_no for r in cat.version_log(log).collect()] == [2, 1, 1]
    now_saved = {r.test_case_id: (r.test_name, r.version_no) for r in v2.collect()}
    assert now_saved == {"1": ("Second", 2), "2": ("Other", 1)}
    back = cat.restored(log, 1).first()
    assert back.version_no == 3 and '"First"' in back.snapshot_json
    assert back.change_note == "Restored from v1"


def test_folder_tree(spark):
    folders = spark.createDataFrame([("F", True), ("G", True), ("H", False)],
                                    "folder_id string, is_active boolean")
    tests = spark.createDataFrame([rule("1"), rule("2", active=False)], DDL)
    got = {r.folder_id: r.test_count for r in history.folder_tree(folders, tests).collect()}
    assert got == {"F": 1, "G": 0}


def test_windows_and_clock_do_not_depend_on_the_session_zone(spark, log):
    zone = spark.conf.get("spark.sql.session.timeZone")
    from plumbline.plans.params import run_clock

    def minutes():
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"),
                                 F.current_timestamp().cast("timestamp_ntz"))
        r = spark.range(1).select(run_clock().alias("a"), utc.alias("b")).first()
        return (r.a - r.b).total_seconds() / 60

    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert ids(history.executions_in(log, "2026-09-01", "2026-09-01")) == ["e1", "e3"]
            assert minutes() == 330
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)

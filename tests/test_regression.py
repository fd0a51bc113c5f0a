from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plumbline.plans import history
from plumbline.plans.regression import outcome, rerun, rerun_failing, run_folder, run_suite, selection
from plumbline.plans.rules import COMPARE, NO_ROWS, Rule
from plumbline.plans.runner import RunLog

SOURCE = [("P1001", 12000.0, "Active"), ("P1002", 8000.0, "Active"), ("P1003", 1.0, "Lapsed")]
DDL = "POLICY_ID string, PREMIUM double, STATUS string"
RULES = [
    Rule("policies", COMPARE, folder="/Regression", test_id="T1", keys=("POLICY_ID",),
         source=lambda t, p: t["SRC"], target=lambda t, p: t["TGT"]),
    Rule("small", NO_ROWS, folder="/Staging", test_id="T2",
         check=lambda t, p: t["TGT"].filter(F.col("PREMIUM") < p["low"]), defaults={"low": 1}),
    Rule("gone", NO_ROWS, folder="/Staging", test_id="T3", active=False, check="SELECT 1"),
]


def test_corrupt_detect_fix_rerun(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    src = spark.createDataFrame(SOURCE, DDL)
    bad = src.withColumn("PREMIUM", F.when(F.col("POLICY_ID") == "P1001", 10000.0)
                         .otherwise(F.col("PREMIUM")))
    broken, fixed = {"SRC": src, "TGT": bad}, {"SRC": src, "TGT": src}

    first = run_suite(spark, RULES, broken, "B", log, project_id="P")
    assert [r.status for r in first.results] == ["FAIL", "PASS"]
    told = outcome(log, first.run_id).first()
    assert (told.total, told.passed, told.failed, told.pass_pct) == (2, 1, 1, 50.0)
    detail = history.failure_detail(log.failures, log.executions, run=first.run_id).first()
    assert (detail.business_key, detail.expected_value, detail.actual_value) == (
        "P1001", "12000", "10000")

    day = str(log.executions.first().run_ts.date())
    again = rerun_failing(spark, RULES, day, day, fixed, "B", log, project_id="P")
    assert [r.rule.test_id for r in again.results] == ["T1"]
    assert outcome(log, again.run_id).first().pass_pct == 100.0
    nothing = rerun_failing(spark, RULES, day, day, fixed, "B", log, project_id="P")
    assert nothing.results == [] and outcome(log, nothing.run_id).isEmpty()
    assert history.latest_failures(log.failures, log.executions, "P").isEmpty()

    runs = history.regression_runs(log.regression_events, log.executions).collect()
    by_id = {r.regression_id: r for r in runs}
    assert (by_id[first.regression_id].passed, by_id[first.regression_id].failed) == (1, 1)
    assert by_id[first.regression_id].completed_ts is not None
    assert by_id[again.regression_id].triggered_from == "EXECUTION_HISTORY"
    assert by_id[again.regression_id].selected_test_ids == ["T1"]


def test_selection_is_deduplicated_current_and_explained(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    src = spark.createDataFrame(SOURCE, DDL)
    tables = {"SRC": src, "TGT": src}
    edited = [RULES[0], replace(RULES[1], defaults={"low": 5}, version=2), RULES[2]]
    out = rerun(spark, edited, ["T2", "T1", "T2", "T9", "T3", ""], tables, "B", log)
    assert [(r.rule.test_id, r.status) for r in out.results] == [("T2", "FAIL"), ("T1", "PASS")]
    wanted = ["T2", "T1", "T2", "T9", "T3", ""]
    assert [(r.test_case_id, r.skipped) for r in selection(spark, edited, wanted).orderBy("position").collect()] == [
        ("T2", None), ("T1", None), ("T9", "could not be loaded"), ("T3", "test case is inactive (deleted)")]
    versions = {r.test_case_id: r.test_version_no for r in log.executions.collect()}
    assert versions == {"T1": 1, "T2": 2}
    folder = run_folder(spark, edited, tables, "B", log)
    assert [r.status for r in folder.results] == ["PASS"]
    with pytest.raises(LookupError, match="/Nope"):
        run_folder(spark, edited, tables, "B", log, "/Nope")


def test_nothing_is_clipped(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    key = "k" * 10_000
    rows = spark.createDataFrame([(key, "v" * 9_000)], "ID string, VALUE string")
    bad = Rule("n" * 300, NO_ROWS, folder="/Staging", test_id="T1", check=lambda t, p: t["R"])
    rerun(spark, [bad], ["T1"], {"R": rows}, "B", log)
    found = log.failures.first()
    assert found.business_key == key and len(found.failure_reason) > 19_000
    assert log.executions.first().test_name == "n" * 300
    many = [f"T{i:05d}" for i in range(5_000)]
    idle = [replace(bad, test_id=t, active=i == 0) for i, t in enumerate(many)]
    assert selection(spark, idle, many).count() == 5_000

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators.rules import (
    RowRule,
    informational,
    no_rows,
    pack,
    rule_failures,
    status_column,
)
from plumbline.plans.params import (
    missing_params,
    preview,
    resolve,
    resolve_column,
    run_sql,
    sql_params,
)
from plumbline.plans.rules import COMPARE, COUNTS, NO_ROWS, REPORT, STATUS, Rule
from plumbline.plans.history import executions_in, failure_detail
from plumbline.plans.runner import RunLog, compare_tables, results_frame, run_rules, whole_suite


def one(df):
    return tuple(df.first())


def test_aliases_feed_the_failure_columns(spark):
    rows = spark.sql("SELECT 'k1' AS key, 'AMT' AS field, 5 AS expected, CAST(NULL AS INT) AS "
                     "actual, 'why' AS message")
    assert one(rule_failures(rows, "T")) == ("k1", "AMT", "5", "<NULL>", "RULE_VIOLATION", "why")


def test_without_aliases_the_row_is_the_reason(spark):
    rows = spark.sql("SELECT 7 AS n, CAST(NULL AS STRING) AS s, array(1, 2) AS a")
    assert one(rule_failures(rows, "My rule")) == (
        "7", "s", "", "", "RULE_VIOLATION", "My rule: n=7, s=<NULL>, a=[1,2]")
    assert one(rule_failures(spark.sql("SELECT 9 AS only"), "T"))[:2] == ("9", "only")
    long = spark.sql("SELECT 1 AS id, repeat('x', 2000) AS t")
    assert len(one(rule_failures(long, "T"))[5]) == 2011  # whole


def test_status_tokens(spark):
    rows = spark.createDataFrame(
        [("a", "PASS"), ("b", " ok\t"), ("c", "true"), ("d", "1"), ("e", "FAIL"), ("f", None)],
        "id string, Status string")
    check = status_column(rows, "T")
    m = check.metrics.first()
    assert (m.status, m.source_row_count, m.matched_record_count, m.failed_record_count) == (
        "FAIL", 6, 4, 2)
    assert sorted(r.business_key for r in check.failures.collect()) == ["e", "f"]
    with pytest.raises(ValueError, match="column named STATUS"):
        status_column(spark.range(1), "T")


def test_zero_rows_and_informational(spark):
    assert no_rows(spark.range(0), "T").metrics.first().status == "PASS"
    m = no_rows(spark.range(3), "T").metrics.first()
    assert (m.status, m.source_row_count, m.failed_record_count) == ("FAIL", 3, 3)
    info = informational(spark.range(3), "T")
    assert info.metrics.first().status == "PASS" and info.failures.isEmpty()


def test_packed_rules_equal_separate_rules(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("m"),
                                   F.when(F.col("id") > 10, F.col("id")).alias("x"))
    rules = [RowRule(n, c, F.col("id"), "m", "e", F.col("x"), "r")
             for n, c in (("A", F.col("m") == 3), ("B", F.col("x") < 20), ("C", F.lit(False)))]
    together = sorted(map(tuple, pack(rows, rules).collect()))
    apart = sorted(t for r in rules for t in map(tuple, pack(rows, [r]).collect()))
    assert together == apart and len(together) == 14 + 9
    plan = pack(rows, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range") == 1 and "Exchange" not in plan


# ---------------------------------------------------------------- parameters
def names(spark, sql):
    return spark.range(1).select(sql_params(F.lit(sql)).alias("p")).first().p


def test_parameter_names(spark):
    assert names(spark, "SELECT ':nope' -- :also_nope\nFROM t WHERE a = :yes") == ["yes"]
    assert names(spark, "SELECT :b, :a, :b") == ["b", "a"]
    assert names(spark, "SELECT x::string, 'it''s :no', /* :no\n:no */ :_p1") == ["_p1"]


def test_precedence_ignores_none(spark):
    now = datetime(2026, 9, 1, 10)
    got = resolve("B", now, {"a": 1, "batch_id": "saved"}, {"a": None, "run_date": "x"})
    assert got == {"batch_id": "saved", "run_date": "x", "run_ts": now, "a": 1}
    assert resolve("B", now, None, {"batch_id": "mine"})["batch_id"] == "mine"
    cell = resolve_column(
        F.lit("B"), F.create_map(F.lit("a"), F.lit("1")),
        F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("3")))
    assert spark.range(1).select(cell.alias("m")).first().m == {"batch_id": "B", "a": "1",
                                                                "c": "3"}
    lacking = missing_params(F.array(F.lit("a"), F.lit("z")), cell)
    assert spark.range(1).select(lacking.alias("x")).first().x == ["z"]


def test_sql_binding(spark):
    assert run_sql(spark, "SELECT :a AS a, ':b' AS b", {"a": 5, "unused": 1}).first() == (5, ":b")
    with pytest.raises(KeyError, match="two, three"):
        run_sql(spark, "SELECT :one, :two, :three", {"one": 1})
    page, n = preview(spark.range(80))
    assert (page.count(), n) == (50, 80)


# ---------------------------------------------------------------- runner
def test_every_kind_is_run_logged_and_isolated(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("five")
    rules = [
        Rule("rows", NO_ROWS, folder="/b", check="SELECT id FROM five WHERE id >= :low",
             defaults={"low": 3}, test_id="T1"),
        Rule("counts", COUNTS, folder="/b", source="SELECT count(*) FROM five",
             target="SELECT * FROM five", test_id="T2"),
        Rule("pairs", COMPARE, folder="/b", source="SELECT id, 1 AS v FROM five",
             target=lambda t, p: t["six"].selectExpr("id", "1 AS v"), keys=("id",), test_id="T3"),
        Rule("status", STATUS, folder="/a", check="SELECT id, 'PASS' AS STATUS FROM five",
             test_id="T4"),
        Rule("report", REPORT, folder="/a", check="SELECT * FROM five", regression=False,
             test_id="T5"),
        Rule("plan error", NO_ROWS, folder="/a", check="SELECT nope FROM five", test_id="T6"),
        Rule("run error", NO_ROWS, folder="/a", test_id="T7",
             check="SELECT CAST(concat('x', id) AS INT) AS id FROM five"),
        Rule("unbound", NO_ROWS, folder="/a", check="SELECT :gone AS id", test_id="T8"),
        Rule("odd kind", "WHAT", test_id="T9"),
        Rule("half", COMPARE, source="SELECT 1", keys=("id",), test_id="T10"),
    ]
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.executions.isEmpty()
    found = run_rules(spark, rules, {"six": spark.range(6)}, "B1", log=log, run_mode="FULL_SUITE")
    by_name = {r.rule.name: r for r in found}
    assert [r.status for r in found] == [
        "FAIL", "PASS", "FAIL", "PASS", "PASS", "ERROR", "ERROR", "ERROR", "ERROR", "ERROR"]
    assert "gone" in by_name["unbound"].error_message
    assert "Unknown test type" in by_name["odd kind"].error_message
    assert by_name["pairs"].matched_record_count == 5
    assert log.executions.count() == 10
    assert log.executions.select("run_id").distinct().count() == 1
    logged = {(f.test_case_id, f.business_key) for f in log.failures.collect()}
    assert logged == {("T1", "3"), ("T1", "4"), ("T3", "5")}
    other = RunLog(spark, str(tmp_path / "other"))
    at_once = run_rules(spark, rules, {"six": spark.range(6)}, "B1", log=other, parallel=5)
    assert other.executions.count() == 10 and other.failures.count() == 3
    assert [r.status for r in at_once] == [r.status for r in found]
    run_rules(spark, rules[:1], {}, "B1", {"low": 4}, log=log)      # an override, appended
    assert log.executions.count() == 11 and log.failures.count() == 4
    assert results_frame(spark, found).filter("status = 'ERROR'").count() == 5
    assert [r.test_id for r in whole_suite(rules[:5])] == ["T4", "T5", "T1", "T2", "T3"]
    assert [r.test_id for r in whole_suite(rules[:5], regression_only=True)] == [
        "T4", "T1", "T2", "T3"]


def test_a_run_is_read_alone(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    bad = Rule("bad", NO_ROWS, check="SELECT id AS KEY FROM range(7) WHERE id > :low", defaults={"low": 4}, test_id="T1")
    for run, low in (("RUN a/b=1", 4), ("RUN é", 3), ("RUN none", 9)):
        found = run_rules(spark, [bad], {}, "B1", {"low": low}, log=log, run_id=run)
        assert found[0].failed_record_count == max(6 - low, 0) == found[0].failures.count()
        assert found[0].status == ("FAIL" if low < 6 else "PASS")
    assert {r.run_id for r in log.executions.collect()} == {"RUN a/b=1", "RUN é", "RUN none"}
    assert log.failures.count() == 5
    one = failure_detail(log.failures, run="RUN é")
    assert sorted(r.business_key for r in one.collect()) == ["4", "5", "6"]
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(run_id" in plan
    today = log.executions.first().run_ts.date()
    assert executions_in(log.executions, today, today).count() == 3
    assert executions_in(log.executions, "2001-01-01", "2001-01-02").count() == 0


def test_a_failing_rule_runs_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(10).mapInPandas(look, "id long")
    rule = Rule("all", NO_ROWS, check=lambda t, p: rows, test_id="T1")
    found = run_rules(spark, [rule], {}, "B1", log=RunLog(spark, str(tmp_path / "log")))
    assert found[0].failed_record_count == 10 and seen.value == 10


def test_a_failing_comparison_and_its_copies_take_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(10).mapInPandas(look, "id long").withColumn("v", F.lit(1))
    other = spark.range(1, 12).withColumn("v", F.when(F.col("id") == 4, 2).otherwise(1))
    pairs = Rule("pairs", COMPARE, source=lambda t, p: rows, target=lambda t, p: other, keys=("id",), test_id="T1")
    copy = Rule(**{**pairs.__dict__, "folder": "/Regression", "test_id": "T2"})
    good = Rule("good", COMPARE, source="SELECT 1 AS id", target="SELECT 1 AS id", keys=("id",), test_id="T3")
    log = RunLog(spark, str(tmp_path / "log"))
    found = run_rules(spark, [pairs, good, copy], {}, "B1", log=log)
    assert seen.value == 10
    assert [r.rule.test_id for r in found] == ["T1", "T3", "T2"] and len({r.execution_id for r in found}) == 3
    assert [(r.status, r.source_row_count, r.target_row_count, r.matched_record_count, r.failed_record_count)
            for r in found] == [("FAIL", 10, 11, 8, 4), ("PASS", 1, 1, 1, 0), ("FAIL", 10, 11, 8, 4)]
    logged = sorted((r.test_case_id, r.execution_id, r.business_key) for r in log.failures.collect())
    assert logged == sorted((r.rule.test_id, r.execution_id, k) for r in (found[0], found[2]) for k in ("0", "4", "10", "11"))
    assert log.failures.select("failure_id").distinct().count() == 8
    # Empty sides are observed as well.
    none = Rule("none", COMPARE, source=lambda t, p: rows.limit(0), target=lambda t, p: other.limit(0), keys=("id",))
    assert [(r.status, r.source_row_count) for r in run_rules(spark, [none], {}, "B1", log=log)] == [("PASS", 0)]


def test_versions_before_a_window_do_not_travel(spark, rows):
    from plumbline.plans.rules import latest_in_window

    trn = spark.sql("SELECT k, BATCH_ID, v, CAST(t AS timestamp_ntz) AS RECORD_EFFECTIVE_TS FROM VALUES "
                    "('a', 'B1', 1, '2020-01-01'), ('a', 'B2', 2, '2020-02-01'), ('b', 'B1', 3, '2020-02-28 23:59:59'), "
                    "('b', 'B2', 4, '2020-03-01'), ('c', 'B1', 5, '2020-01-31 23:59:59'), ('d', 'B1', 6, NULL), "
                    "('e', 'B1', 7, '2020-02-02'), ('e', 'B2', 8, '2020-02-02'), ('f', 'B1', 9, '2020-02-28'), "
                    "('f', 'B2', 10, NULL) AS x(k, BATCH_ID, v, t)")
    found = latest_in_window(trn, "k", "2020-02-01", "2020-02-28")
    assert found.columns == trn.columns
    assert rows(found, "k", "v") == [("a", 2), ("e", 8), ("f", 9)]
    read = spark.createDataFrame(trn.collect(), trn.schema)
    plan = latest_in_window(read, "k", "2020-02-01", "2020-02-28")._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 2020-02-01 00:00:00" in plan[plan.rindex("Window"):]


def test_a_window_takes_no_more_than_the_key_of_later_versions(spark, rows):
    from plumbline.plans.rules import latest_in_window

    trn = spark.sql("SELECT k, BATCH_ID, v, CAST(t AS timestamp_ntz) AS RECORD_EFFECTIVE_TS FROM VALUES "
                    "('a', 'B1', 1, '2020-02-28 23:59:59.999999'), ('a', 'B2', 2, '2020-03-01'), ('a', 'B3', 3, '2021-01-01'), "
                    "(NULL, 'B1', 4, '2020-02-02'), (NULL, 'B1', 5, '2020-05-05'), ('b', 'B1', 6, '2020-02-03'), "
                    "('b', 'B2', 7, '2020-02-28 23:59:59.999999') AS x(k, BATCH_ID, v, t)")
    found = latest_in_window(trn, "k", "2020-02-01", "2020-02-28")
    assert rows(found, "k", "BATCH_ID", "v", "RECORD_EFFECTIVE_TS") == [
        ("b", "B2", 7, datetime(2020, 2, 28, 23, 59, 59, 999999))]
    read = spark.createDataFrame(trn.collect(), trn.schema)
    plan = latest_in_window(read, "k", "2020-02-01", "2020-02-28")._jdf.queryExecution().optimizedPlan().toString()
    assert "least(RECORD_EFFECTIVE_TS" in plan


def test_checks_of_a_run_share_what_they_match_by_key(spark, tmp_path):
    """Each table is planned once for the run, outcomes are those of the checks alone, and nothing stays held."""
    from plumbline.plans import mapping
    from plumbline.plans.rules import builtin_rules

    staged = spark.createDataFrame(
        [(f"CL{i}", f"P{i % 5}", "C1", None, Decimal(i), Decimal(i % 3), "A", "Fire", None, "B1" if i % 2 else "B2") for i in range(1, 41)],
        "CLAIM_ID string, POLICY_ID string, CUSTOMER_ID string, CLAIM_DATE date, CLAIM_AMOUNT decimal(12,2), "
        "APPROVED_AMOUNT decimal(12,2), CLAIM_STATUS string, INCIDENT_TYPE string, LAST_UPDATED_TS timestamp_ntz, BATCH_ID string")
    trn = mapping.map_claim(staged)
    curated = mapping.claim_rows(trn).filter("CLAIM_ID <> 'CL7'").withColumn(
        "CLAIM_STATUS", F.when(F.col("CLAIM_ID") == "CL9", "Pending").otherwise(F.col("CLAIM_STATUS")))
    policies = spark.range(4).selectExpr("'P' || id AS POLICY_ID", "date'2020-01-01' AS ISSUE_DATE", "date'2020-02-01' AS EXPIRY_DATE")
    asked, held = [], spark.sparkContext._jsc.sc().getPersistentRDDs().size()

    class Tables(dict):
        def __getitem__(self, name):
            asked.append(name)
            return super().__getitem__(name)

    names = ("Claim transformation vs curated", "No orphan claims in curated", "Claim date inside policy coverage",
             "Claim ratio derivation")
    chosen = [r for r in builtin_rules() if r.name in names and r.folder != "/Regression"]
    tables = Tables(STG_CLAIM=staged, TRN_CLAIM=trn, CLAIM_MASTER=curated, POLICY_MASTER=policies)

    def told(results):
        return {r.rule.name: (r.status, r.source_row_count, r.target_row_count, r.matched_record_count,
                              r.failed_record_count, r.error_message) for r in results}

    found = told(run_rules(spark, chosen, tables, "B1", log=RunLog(spark, str(tmp_path / "log")), parallel=2))
    assert sorted(asked) == ["CLAIM_MASTER", "POLICY_MASTER", "STG_CLAIM", "TRN_CLAIM"]
    alone = {}
    for rule in chosen:
        alone |= told(run_rules(spark, [rule], tables, "B1"))
    assert found == alone and found["Claim transformation vs curated"] == ("FAIL", 20, 19, 18, 2, "")
    assert found["No orphan claims in curated"][4] == 4
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held


def test_compare_tables_defaults(spark):
    a = spark.createDataFrame([("B1", "x", 1), ("B2", "y", 2)],
                              "BATCH_ID string, ROW_ID string, v int")
    b = spark.createDataFrame([("x", 1)], "row_id string, v int")
    assert compare_tables(a, b, batch_id="B1").metrics.first().status == "PASS"
    assert compare_tables(a, b).metrics.first().failed_record_count == 1
    assert compare_tables(a, b, counts_only=True).metrics.first().status == "FAIL"


def test_claims_of_a_run_are_matched_where_they_lie(spark, tmp_path, monkeypatch):
    """
    Staged claims are linked to policies once, by id and policy; claims with an id in common are told apart, and what
    the checks of a run find is what each finds alone. A run's staged claims do not travel again as rows.
    """
    from plumbline.plans import rules as saved
    from plumbline.plans import mapping

    staged = spark.createDataFrame(
        [(c, p, "C1", None, Decimal(10), Decimal(5), "A", "Fire", None, "B1") for c, p in (
            ("CL1", "P1"), ("CL1", "P9"), ("CL2", "P9"), ("CL3", None), ("CL4", "P2"), ("CL5", "P3"), (None, "P1"), ("", "P8"), ("", "P1"))],
        "CLAIM_ID string, POLICY_ID string, CUSTOMER_ID string, CLAIM_DATE date, CLAIM_AMOUNT decimal(12,2), "
        "APPROVED_AMOUNT decimal(12,2), CLAIM_STATUS string, INCIDENT_TYPE string, LAST_UPDATED_TS timestamp_ntz, BATCH_ID string")
    policies = spark.createDataFrame([("P1", "C1", "B1"), ("P3", "C1", "B1")], "POLICY_ID string, CUSTOMER_ID string, BATCH_ID string")
    master = spark.createDataFrame([("P2", "2020-01-01", "2020-02-01")], "POLICY_ID string, ISSUE_DATE string, EXPIRY_DATE string").select(
        "POLICY_ID", F.col("ISSUE_DATE").cast("date").alias("ISSUE_DATE"), F.col("EXPIRY_DATE").cast("date").alias("EXPIRY_DATE"))
    curated = mapping.claim_rows(mapping.map_claim(staged)).withColumn("CLAIM_DATE", F.lit("2021-01-01").cast("date"))
    tables = {"STG_CLAIM": staged, "STG_POLICY": policies, "TRN_CLAIM": mapping.map_claim(staged), "POLICY_MASTER": master,
              "CLAIM_MASTER": curated}
    names = ("Claim references an existing policy", "Claim staging vs curated (mapping rules)", "No orphan claims in curated",
             "Claim date inside policy coverage")
    chosen = [r for r in saved.builtin_rules() if r.name in names and r.folder != "/Regression"]
    looked = []
    monkeypatch.setattr(saved, "unlinked", lambda *a, real=saved.unlinked: looked.append(a[1]) or real(*a))
    monkeypatch.setattr(mapping, "linked", lambda *a: pytest.fail("linked again"))

    def told(log, results):
        kept = {} if log is None else {r.test_case_id: r.n for r in log.failures.groupBy("test_case_id").agg(F.count("*").alias("n")).collect()}
        return {r.rule.name: (r.status, r.source_row_count, r.target_row_count, r.failed_record_count, r.error_message) for r in results}, kept

    log = RunLog(spark, str(tmp_path / "log"))
    found, kept = told(log, run_rules(spark, chosen, tables, "B1", log=log, parallel=2))
    assert looked == ["POLICY_ID"] and not any(f[-1] for f in found.values())
    monkeypatch.undo()
    alone = {}
    for rule in chosen:
        alone |= told(None, run_rules(spark, [rule], tables, "B1"))[0]
    assert found == alone and found[names[0]][3] == 4 and found[names[1]][1] == 4
    assert sorted(kept.values()) == sorted(f[3] for f in found.values() if f[3])
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

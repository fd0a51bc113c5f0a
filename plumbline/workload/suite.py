"""Every saved check as one run over the derived layers: its outcome, its counts and what the log kept of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.rules import builtin_rules
from plumbline.plans.runner import RunLog, results_frame, run_rules, whole_suite
from plumbline.session import scratch
from plumbline.workload import sql
from plumbline.workload.feed import BATCHES, LOST, Feed
from plumbline.workload.layers import (
    _CLAIM_COLS, _CLAIM_SRC, _POLICY_COLS, _POLICY_SRC, PROCESSES, _batch_scope, _marks_sql, marks_after,
)

B1 = BATCHES[0]
DAYS = ("1995-01-01", "1996-06-30")  # of the historical checks
COUNTS = ("source_row_count", "target_row_count", "matched_record_count", "failed_record_count")


def tables_after(feed: Feed, *batches: str) -> dict[str, DataFrame]:
    """All that the saved checks read, after loading batches in this order; the last one's claims file lacks some days."""
    staged = [rows.select("BATCH_ID") for rows in (feed.stg_customer, feed.stg_policy, feed.stg_claim)]
    return {
        **feed.tables(),
        "DQ_WATERMARK": marks_after(feed, *batches),
        "DQ_BATCH_METADATA": reduce(DataFrame.unionByName, staged).groupBy("BATCH_ID").agg(
            F.count(F.lit(1)).alias("SOURCE_ROWS")),
        "CLAIMS": feed.stg_claim.filter((F.col("BATCH_ID") == batches[-1]) & (F.dayofmonth("CLAIM_DATE") != LOST)),
    }


def whole_run(feed: Feed) -> DataFrame:
    """All 29 saved checks for the first batch; its claims file lacks some days."""
    log = RunLog(feed.spark, scratch(feed.spark, "log"))
    results = run_rules(feed.spark, whole_suite(builtin_rules()), tables_after(feed, B1), B1,
                        dict(zip(("history_start", "history_end"), DAYS)), log=log, parallel=4)
    logged = log.failures.groupBy(F.col("test_case_id").alias("test_id")).agg(F.count(F.lit(1)).alias("kept"))
    return results_frame(feed.spark, results).join(logged, "test_id", "left").select(
        "test_id", "status", *COUNTS, "truncated", F.coalesce("kept", F.lit(0)).cast("bigint").alias("logged"))


# ---------------------------------------------------------------- the same in SQL
def _of_batch(table: str) -> str:
    return f"SELECT * FROM {table} WHERE BATCH_ID = '{B1}'"


def _no_rows(names: str, rows: str, **extra: str) -> str:
    """Metrics of a rule that FROM clause ``rows`` breaks."""
    return sql.using(names, "SELECT CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, "
                     "count(*) AS source_row_count, 0 AS target_row_count, 0 AS matched_record_count, "
                     f"count(*) AS failed_record_count, count(*) > 1000 AS truncated FROM {rows}", **extra)


def _good(names: str, n: str, target: str) -> str:
    """Metrics of a check that passes with ``n`` rows."""
    return sql.using(names, f"SELECT 'PASS' AS status, n AS source_row_count, {target} AS target_row_count, "
                     f"n AS matched_record_count, 0 AS failed_record_count, false AS truncated FROM ({n})")


def _compare(names: str, key: str, columns: dict, src: str, tgt: str, **extra) -> str:
    return sql.reconcile(names, {key: "text"}, columns, metrics=True, src=src, tgt=tgt, **extra)


def _in_days(c: str) -> str:
    return f"{c} >= TIMESTAMP '{DAYS[0]}' AND {c} < TIMESTAMP '{DAYS[1]}' + INTERVAL 1 DAY"


def _checks() -> list[str]:
    """One statement per saved check, in the order of their ids."""
    policy = _compare("policy_master", "POLICY_ID", _POLICY_COLS, f"{_POLICY_SRC} WHERE BATCH_ID = '{B1}'",
                      _batch_scope("policy_master", "trn_policy", "POLICY_ID", B1))
    claim = _compare("claim_master", "CLAIM_ID", _CLAIM_COLS, f"{_CLAIM_SRC} WHERE BATCH_ID = '{B1}'",
                     _batch_scope("claim_master", "trn_claim", "CLAIM_ID", B1))
    scope = f"CLAIM_ID IN (SELECT CLAIM_ID FROM trn_claim WHERE BATCH_ID = '{B1}')"
    orphans = _no_rows("claim_master policy_master", f"claim_master c WHERE {scope} AND NOT EXISTS "
                       "(SELECT 1 FROM policy_master p WHERE p.POLICY_ID = c.POLICY_ID)")
    outside = _no_rows("claim_master policy_master", "claim_master c JOIN policy_master p ON p.POLICY_ID = "
                       f"c.POLICY_ID WHERE {scope} AND (c.CLAIM_DATE < p.ISSUE_DATE OR c.CLAIM_DATE > p.EXPIRY_DATE)")
    known = (f"(EXISTS (SELECT 1 FROM stg_policy p WHERE p.POLICY_ID = c.POLICY_ID AND p.BATCH_ID = '{B1}') "
             "OR EXISTS (SELECT 1 FROM policy_master m WHERE m.POLICY_ID = c.POLICY_ID))")
    batch_claims = f"stg_claim c WHERE c.BATCH_ID = '{B1}'"
    moneys = {"CLAIM_AMOUNT": "num", "APPROVED_AMOUNT": "num"}
    want_type = sql.decode("s.POLICY_TYPE", sql._TYPES)
    want_ratio = sql.ratio("s.APPROVED_AMOUNT", "s.CLAIM_AMOUNT")
    touched = (f"SELECT CUSTOMER_ID FROM trn_customer WHERE BATCH_ID = '{B1}' UNION SELECT CUSTOMER_ID FROM trn_policy "
               f"WHERE BATCH_ID = '{B1}' UNION SELECT p.CUSTOMER_ID FROM trn_claim t JOIN policy_master p ON "
               f"p.POLICY_ID = t.POLICY_ID WHERE t.BATCH_ID = '{B1}'")

    def boundary(trn: str) -> str:
        process = PROCESSES[trn.upper()]
        late = ("t.RECORD_EFFECTIVE_TS <= w.PREVIOUS_WATERMARK OR t.RECORD_EFFECTIVE_TS > w.BATCH_HIGH_WATERMARK")
        return _no_rows("trn_customer trn_policy trn_claim", f"(SELECT 1 FROM {trn} t JOIN marks w ON w.PROCESS_NAME = "
                        f"'{process}' AND w.LAST_BATCH_ID = t.BATCH_ID WHERE t.BATCH_ID = '{B1}' AND ({late}))",
                        marks=_marks_sql(B1))

    return [
        _good("stg_customer stg_policy stg_claim", "SELECT " + " + ".join(
            f"(SELECT count(*) FROM {t} WHERE BATCH_ID = '{B1}')" for t in ("stg_customer", "stg_policy", "stg_claim"))
            + " AS n", "n"),
        _compare("stg_claim", "CLAIM_ID", {"POLICY_ID": "text", "CUSTOMER_ID": "text", "CLAIM_DATE": "date", **moneys,
                                           "CLAIM_STATUS": "text", "INCIDENT_TYPE": "text"},
                 f"{_of_batch('stg_claim')} AND day(CLAIM_DATE) <> {LOST}", _of_batch("stg_claim")),
        _no_rows("stg_policy", f"({_of_batch('stg_policy')} AND (POLICY_ID IS NULL OR trim(POLICY_ID) = ''))"),
        _no_rows("stg_policy", f"(SELECT POLICY_ID FROM stg_policy WHERE BATCH_ID = '{B1}' GROUP BY POLICY_ID HAVING count(*) > 1)"),
        _no_rows("stg_claim policy_master", f"{batch_claims} AND NOT {known}"),
        _no_rows("stg_claim", f"{batch_claims} AND (APPROVED_AMOUNT < 0 OR APPROVED_AMOUNT > CLAIM_AMOUNT)"),
        _no_rows("trn_policy", "stg_policy s JOIN trn_policy t ON t.POLICY_ID = s.POLICY_ID AND t.BATCH_ID = s.BATCH_ID "
                 f"WHERE s.BATCH_ID = '{B1}' AND t.POLICY_TYPE_DESC <> {want_type}"),
        _no_rows("trn_policy", f"({_of_batch('trn_policy')} AND (EXPIRY_DATE < ISSUE_DATE OR "
                 "POLICY_TERM_DAYS <> EXPIRY_DATE - ISSUE_DATE))"),
        _no_rows("trn_claim", "stg_claim s JOIN trn_claim t ON t.CLAIM_ID = s.CLAIM_ID AND t.BATCH_ID = s.BATCH_ID WHERE "
                 f"s.BATCH_ID = '{B1}' AND (abs(coalesce(t.CLAIM_RATIO, 0) - {want_ratio}) > 0.0001 OR t.CLAIM_RATIO NOT BETWEEN 0 AND 1)"),
        _no_rows("trn_customer", f"({_of_batch('trn_customer')} AND (EMAIL <> lower(trim(EMAIL)) OR EMAIL NOT LIKE '%@%.%'))"),
        policy,
        claim,
        sql.reconcile("customer_360", {"CUSTOMER_ID": "text"},
                      {"TOTAL_PREMIUM": "num", "TOTAL_CLAIMS": "int", "TOTAL_CLAIM_AMOUNT": "num"}, metrics=True,
                      tolerance="0.01", touched=touched, src="SELECT * FROM true_360 WHERE CUSTOMER_ID IN (FROM touched)",
                      tgt="SELECT * FROM customer_360 WHERE CUSTOMER_ID IN (FROM touched)"),
        _compare("policy_master", "POLICY_ID", {**_POLICY_COLS, "ISSUE_DATE": "date", "EXPIRY_DATE": "date"},
                 f"{_POLICY_SRC} WHERE BATCH_ID = '{B1}'", _batch_scope("policy_master", "stg_policy", "POLICY_ID", B1)),
        _compare("claim_master policy_master", "CLAIM_ID", {**_CLAIM_COLS, "CLAIM_DATE": "date"},
                 f"SELECT * FROM ({_CLAIM_SRC}) c WHERE c.BATCH_ID = '{B1}' AND {known}",
                 _batch_scope("claim_master", "stg_claim", "CLAIM_ID", B1)),
        _compare("customer_360", "CUSTOMER_ID", {"CUSTOMER_NAME": "text", "EMAIL": "text"}, _of_batch("trn_customer"),
                 _batch_scope("customer_360", "stg_customer", "CUSTOMER_ID", B1)),
        orphans,
        outside,
        boundary("trn_policy"),
        boundary("trn_claim"),
        boundary("trn_customer"),
        sql.using("trn_customer trn_policy trn_claim", "SELECT 'PASS' AS status, count(*) AS source_row_count, 0 AS "
                  "target_row_count, count(*) AS matched_record_count, 0 AS failed_record_count, false AS truncated FROM marks",
                  marks=_marks_sql(B1)),
        _compare("policy_master", "POLICY_ID", _POLICY_COLS, f"{_POLICY_SRC} WHERE {_in_days('RECORD_EFFECTIVE_TS')}",
                 f"SELECT * FROM policy_master WHERE {_in_days('LAST_UPDATED_TS')}"),
        _compare("claim_master", "CLAIM_ID", {"POLICY_ID": "text", "CLAIM_STATUS": "text", **moneys},
                 f"{_CLAIM_SRC} WHERE {_in_days('RECORD_EFFECTIVE_TS')}",
                 f"SELECT * FROM claim_master WHERE {_in_days('LAST_UPDATED_TS')}"),
        _compare("customer_360", "CUSTOMER_ID", {"CUSTOMER_NAME": "text", "EMAIL": "text"},
                 f"SELECT * FROM trn_customer WHERE {_in_days('RECORD_EFFECTIVE_TS')}",
                 f"SELECT * FROM customer_360 WHERE {_in_days('LAST_UPDATED_TS')}"),
        policy,
        claim,
        orphans,
        outside,
    ]


def queries() -> dict:
    counts = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in COUNTS)
    return {"suite_outcomes": (whole_run, " UNION ALL ".join(
        f"SELECT 'TC-{i:04d}' AS test_id, status, {counts}, coalesce(truncated, false) AS truncated, "
        f"CAST(coalesce(failed_record_count, 0) AS BIGINT) AS logged FROM ({text})"
        for i, text in enumerate(_checks(), start=1)))}

"""Saved and ad-hoc checks as users run them: SQL text, parameters, refusals, failing checks, batch metadata."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.preload import LoadCheck, spec_for
from plumbline.operators.screen import reconcile_screened
from plumbline.plans.params import preview, resolve, run_sql
from plumbline.plans.promote import findings, stage
from plumbline.plans.rules import NO_ROWS, Rule, builtin_rules
from plumbline.plans.runner import build, compare_tables, results_frame, run_rules
from plumbline.session import scratch
from plumbline.sources.tables import TableStore
from plumbline.workload import sql
from plumbline.workload.compare import _ORDER_COLS, _ORDER_SRC, order_source
from plumbline.workload.feed import LOST, WRONG, Feed

RUN_TS = datetime(2026, 9, 1, 12, 0)

_SQL_RULE = """
SELECT o_orderkey AS BUSINESS_KEY, 'O_TOTALPRICE' AS COLUMN_NAME, concat('at most ', :high) AS EXPECTED_VALUE,
       o_orderstatus AS ACTUAL_VALUE, concat('Seen on ', :run_date, ' by ', :batch_id) AS FAILURE_REASON
FROM plumbline_orders -- not :a_parameter
WHERE o_totalprice > :high AND o_orderstatus = :status AND ':nope' <> o_orderpriority
"""


def _views(feed: Feed) -> None:
    feed.table("orders").createOrReplaceTempView("plumbline_orders")


def sql_rule(feed: Feed) -> DataFrame:
    """A rule of SQL text: built-in values, its saved defaults, then the caller's, where None is ignored."""
    _views(feed)
    rule = Rule("Large open orders", NO_ROWS, check=_SQL_RULE, defaults={"high": 200000, "status": "O"})
    values = resolve("BATCH_7", RUN_TS, rule.defaults, {"status": "F", "high": None})
    return build(feed.spark, rule, {}, values).failures


def sql_preview(feed: Feed) -> DataFrame:
    """The first rows of SQL text, with how many there are in all."""
    _views(feed)
    rows = run_sql(feed.spark, "SELECT o_orderkey, o_totalprice FROM plumbline_orders WHERE o_custkey % :k = 1 "
                               "ORDER BY o_totalprice DESC, o_orderkey", {"k": 7})
    first, total = preview(rows, 25)
    return first.withColumn("total", F.lit(total).cast("bigint"))


def table_pair(feed: Feed) -> DataFrame:
    """One table against another by the usual defaults: the first shared key column, a batch on the side that has one."""
    rows = feed.table("orders").select(
        F.col("o_orderkey").alias("ORDER_ID"), F.col("o_custkey").alias("CUSTOMER_ID"), F.col("o_orderstatus").alias("STATUS"),
        F.concat(F.lit("B"), F.col("o_custkey") % 3).alias("BATCH_ID"))
    other = rows.filter("BATCH_ID = 'B1'").drop("BATCH_ID").withColumn(
        "STATUS", F.when(F.col("ORDER_ID") % WRONG == 0, "X").otherwise(F.col("STATUS"))).filter(F.col("ORDER_ID") % LOST != 0)
    return compare_tables(rows, other, batch_id="B1").metrics


def refused_loads(feed: Feed) -> DataFrame:
    """What stands against loading a file without two of its columns, one without rows, and promoting an empty batch."""
    customers = feed.stg_customer.drop("BATCH_ID", "LOAD_TS")
    spec = spec_for("STG_CUSTOMER")
    told = [("no columns", *LoadCheck(customers.drop("EMAIL", "CITY"), spec).blocking()),
            ("no rows", *LoadCheck(customers.filter("CUSTOMER_ID = 'none'"), spec).blocking())]
    store = TableStore(feed.spark, scratch(feed.spark, "refused"))
    stage(store, "STG_CUSTOMER", customers, "B1", source_file="customers.csv")
    empty = findings(store, "B2").select(F.lit("empty batch").alias("asked"), F.concat_ws(" ", "severity", "finding").alias("answer"))
    whole = findings(store, "B1").agg(F.count("*").alias("n")).select(
        F.lit("staged batch").alias("asked"), F.concat(F.col("n").cast("string"), F.lit(" findings")).alias("answer"))
    return feed.spark.createDataFrame(told, "asked string, answer string").unionByName(empty).unionByName(whole)


def _staged(feed: Feed) -> TableStore:
    store = TableStore(feed.spark, scratch(feed.spark, "metadata"))
    customers = feed.stg_customer.drop("BATCH_ID", "LOAD_TS").withColumn("half", F.pmod(F.xxhash64("CUSTOMER_ID"), F.lit(2)))
    for half in (0, 1):
        stage(store, "STG_CUSTOMER", customers.filter(F.col("half") == half).drop("half"), "B1",
              source_file=f"customers_{half}.csv", replace=False)
    stage(store, "STG_POLICY", feed.stg_policy.drop("BATCH_ID", "LOAD_TS"), "B1", source_file="policies.csv")
    stage(store, "STG_POLICY", feed.stg_policy.drop("BATCH_ID", "LOAD_TS"), "B1", source_file="policies.csv")
    return store


def batch_metadata(feed: Feed) -> DataFrame:
    """The metadata row of a batch that came in three files, one of them twice."""
    return _staged(feed)["DQ_BATCH_METADATA"].select("BATCH_ID", "SOURCE_FILE", "SOURCE_ROWS", "LOADED_ROWS", "REJECT_ROWS", "LOAD_STATUS")


def saved_file_to_stage(feed: Feed) -> DataFrame:
    """The saved count check over the batch's recorded rows and what is staged."""
    rule = next(r for r in builtin_rules() if r.name == "File-to-stage row count reconciliation")
    return build(feed.spark, rule, _staged(feed), {"batch_id": "B1"}).metrics


def failing_checks(feed: Feed) -> DataFrame:
    """Checks that fail to plan or to run are errors of their own; the others still run."""
    _views(feed)
    checks = [
        ("T1", "SELECT o_orderkey AS BUSINESS_KEY FROM plumbline_orders WHERE o_totalprice < 0"),
        ("T2", "SELECT no_such_column FROM plumbline_orders"),
        ("T3", "SELECT o_orderkey AS BUSINESS_KEY FROM plumbline_orders WHERE o_orderstatus = :status"),
        ("T4", "SELECT o_orderkey AS BUSINESS_KEY FROM plumbline_orders WHERE CAST(o_orderpriority AS INT) = 1"),
        ("T5", "SELECT o_orderkey AS BUSINESS_KEY FROM plumbline_orders WHERE o_orderstatus = 'F'"),
    ]
    rules = [Rule(name, NO_ROWS, check=text, test_id=name) for name, text in checks]
    results = run_rules(feed.spark, rules, {}, "B1")
    return results_frame(feed.spark, results).select(
        F.col("test_id").alias("test_case_id"), "status", F.col("failed_record_count").alias("failed"),
        (F.coalesce("error_message", F.lit("")) != "").alias("told"))


def plain_text_orders(feed: Feed) -> DataFrame:
    """Orders as plain text against the typed table, screened by digests of canonical cells."""
    typed = order_source(feed)
    day = F.dayofmonth("o_orderdate")
    text = typed.select([F.col(c).cast("string").alias(c) for c in typed.columns]).withColumn(
        "o_totalprice", F.when(F.dayofmonth(F.col("o_orderdate").cast("date")) == WRONG, "n/a").otherwise(
            F.regexp_replace("o_totalprice", r"\.?0+$", "")))
    return reconcile_screened(text, typed.filter(day != LOST), ["o_orderkey"]).failures


def queries() -> dict:
    return {
        "sql_rule": (sql_rule, """
            SELECT CAST(o_orderkey AS VARCHAR) AS business_key, 'O_TOTALPRICE' AS column_name, 'at most 200000' AS expected_value,
                   o_orderstatus AS actual_value, 'RULE_VIOLATION' AS failure_type, 'Seen on 2026-09-01 by BATCH_7' AS failure_reason
            FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'"""),
        "sql_preview": (sql_preview, """
            SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_custkey % 7 = 1
            ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"""),
        "table_pair": (table_pair, sql.reconcile(
            "", {"ORDER_ID": "int"}, {"CUSTOMER_ID": "int", "STATUS": "text"}, metrics=True,
            src="SELECT o_orderkey AS ORDER_ID, o_custkey AS CUSTOMER_ID, o_orderstatus AS STATUS FROM orders WHERE o_custkey % 3 = 1",
            tgt=f"SELECT ORDER_ID, CUSTOMER_ID, CASE WHEN ORDER_ID % {WRONG} = 0 THEN 'X' ELSE STATUS END AS STATUS FROM src "
                f"WHERE ORDER_ID % {LOST} <> 0")),
        "refused_loads": (refused_loads, """
            SELECT 'no columns' AS asked, 'missing column(s): EMAIL, CITY' AS answer UNION ALL
            SELECT 'no rows', 'The file has no rows.' UNION ALL SELECT 'empty batch', 'BLOCK EMPTY_BATCH' UNION ALL
            SELECT 'staged batch', '0 findings'"""),
        "batch_metadata": (batch_metadata, """
            SELECT 'B1' AS BATCH_ID, 'customers_0.csv, customers_1.csv, policies.csv' AS SOURCE_FILE, n AS SOURCE_ROWS,
                   n AS LOADED_ROWS, CAST(0 AS BIGINT) AS REJECT_ROWS, 'LOADED' AS LOAD_STATUS
            FROM (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n)"""),
        "saved_file_to_stage": (saved_file_to_stage, """
            SELECT 'PASS' AS status, n AS source_row_count, n AS target_row_count, n AS matched_record_count,
                   CAST(0 AS BIGINT) AS failed_record_count, false AS truncated
            FROM (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n)"""),
        "failing_checks": (failing_checks, """
            SELECT 'T1' AS test_case_id, 'PASS' AS status, CAST(0 AS BIGINT) AS failed, false AS told UNION ALL
            SELECT 'T2', 'ERROR', 0, true UNION ALL SELECT 'T3', 'ERROR', 0, true UNION ALL SELECT 'T4', 'ERROR', 0, true UNION ALL
            SELECT 'T5', 'FAIL', count(*), false FROM orders WHERE o_orderstatus = 'F'"""),
        "reconcile_screened_text": (plain_text_orders, sql.reconcile(
            "", {"O_ORDERKEY": "int"}, {**_ORDER_COLS, "O_TOTALPRICE": "text"}, base=_ORDER_SRC,
            src="SELECT * REPLACE (CASE WHEN day(O_ORDERDATE) = " f"{WRONG} THEN 'n/a' ELSE {sql.plain('O_TOTALPRICE')} END AS O_TOTALPRICE) FROM base",
            tgt=f"SELECT * REPLACE ({sql.plain('O_TOTALPRICE')} AS O_TOTALPRICE) FROM base WHERE day(O_ORDERDATE) <> {LOST}")),
    }

"""Reconciliation and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.latest import duplicate_keys
from plumbline.operators.reconcile import match_row_counts, reconcile
from plumbline.operators.rules import (
    RowRule,
    informational,
    no_rows,
    pack,
    rule_failures,
    status_column,
)
from plumbline.operators.screen import reconcile_screened
from plumbline.plans import rules
from plumbline.workload import sql
from plumbline.workload.feed import (
    BLANK,
    FOREIGN,
    KEY_SHIFT,
    LOST,
    TWICE,
    WRONG,
    Feed,
)

ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def order_source(feed: Feed) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(12,2)")
    return feed.table("orders").withColumn("o_totalprice", price).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("date"))


def order_target(feed: Feed) -> DataFrame:
    """The orders as a faulty load left them."""
    src = order_source(feed)
    day = F.dayofmonth("o_orderdate")
    price = F.when(day == WRONG, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = src.filter(day != LOST).withColumns({
        "o_totalprice": price.cast("decimal(12,2)"),
        "o_orderstatus": F.when(day == BLANK, F.lit(None)).otherwise(F.col("o_orderstatus")),
    })
    again = src.filter(day == TWICE)
    foreign = src.filter(day == FOREIGN).withColumn("o_orderkey", F.col("o_orderkey") + KEY_SHIFT)
    return kept.unionByName(again).unionByName(foreign)


_ORDER_SRC = (
    "SELECT o_orderkey AS O_ORDERKEY, o_custkey AS O_CUSTKEY, o_orderstatus AS O_ORDERSTATUS, "
    "CAST(o_totalprice AS DECIMAL(12,2)) AS O_TOTALPRICE, CAST(o_orderdate AS DATE) "
    "AS O_ORDERDATE, o_orderpriority AS O_ORDERPRIORITY FROM orders"
)
_ORDER_TGT = (
    "SELECT * REPLACE (CASE WHEN day(O_ORDERDATE) = 5 THEN NULL ELSE O_ORDERSTATUS END "
    "AS O_ORDERSTATUS, CAST(CASE WHEN day(O_ORDERDATE) = 23 THEN O_TOTALPRICE + 1 "
    "ELSE O_TOTALPRICE END AS DECIMAL(12,2)) AS O_TOTALPRICE) FROM src WHERE day(O_ORDERDATE) "
    "<> 13 UNION ALL SELECT * FROM src WHERE day(O_ORDERDATE) = 19 UNION ALL "
    "SELECT * REPLACE (O_ORDERKEY + 1000000000 AS O_ORDERKEY) FROM src "
    "WHERE day(O_ORDERDATE) = 17"
)
_ORDER_KEYS = {"O_ORDERKEY": "int"}
_ORDER_COLS = {"O_CUSTKEY": "int", "O_ORDERSTATUS": "text", "O_TOTALPRICE": "num",
               "O_ORDERDATE": "date", "O_ORDERPRIORITY": "text"}


def orders_check(feed: Feed, method=reconcile):
    return method(order_source(feed), order_target(feed), ["o_orderkey"])


# ---------------------------------------------------------------- reconcile
def near_prices(feed: Feed):
    """Premiums off by a cent pass under the tolerance, off by two do not."""
    src = order_source(feed).select("o_orderkey", "o_totalprice")
    day = F.dayofmonth("o_orderdate")
    off = F.when(day == WRONG, "0.01").when(day == TWICE, "-0.02").otherwise("0")
    tgt = order_source(feed).select(
        "o_orderkey", (F.col("o_totalprice") + off.cast("decimal(12,2)")).alias("o_totalprice")
    )
    return reconcile(src, tgt, ["o_orderkey"], tolerance=0.01)


def text_orders(feed: Feed):
    """Orders as a text file spells them, against the typed table."""
    t = order_source(feed)
    day = F.dayofmonth("o_orderdate")
    text = t.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.concat(F.lit(" "), "o_custkey").alias("o_custkey"),
        F.concat("o_orderstatus", F.lit("\t ")).alias("o_orderstatus"),
        F.concat(F.col("o_totalprice").cast("string"), F.lit("00")).alias("o_totalprice"),
        F.when(day == WRONG, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(day == TWICE, F.concat(F.col("o_orderdate").cast("string"), F.lit("T00:00")))
        .otherwise(F.col("o_orderdate").cast("string")).alias("o_orderdate"),
    )
    return reconcile(text, t.drop("o_orderpriority"), ["o_orderkey"])


def line_items(feed: Feed) -> DataFrame:
    return feed.table("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("l_quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("l_extendedprice"), "l_returnflag",
        F.col("l_shipdate").cast("date").alias("l_shipdate"),
    )


def composite_key(feed: Feed, method=reconcile):
    """A two-part key that repeats on both sides."""
    src = line_items(feed)
    day = F.dayofmonth("l_shipdate")
    tgt = src.filter(day != LOST).withColumn(
        "l_returnflag", F.when(day == WRONG, "?").otherwise(F.col("l_returnflag")))
    return method(src, tgt, ["l_orderkey", "l_linenumber"])


def count_match(feed: Feed):
    """Policies staged against policies in curated."""
    return match_row_counts(
        feed.stg_policy.agg(F.count(F.lit(1)).alias("n")), feed.policy_master
    )


def file_to_stage(feed: Feed):
    """The delivered row count against the three staging tables, where one day went missing."""
    landed = feed.stg_policy.filter(F.dayofmonth("ISSUE_DATE") != LOST)

    def stacked(policies: DataFrame) -> DataFrame:
        return (
            feed.stg_customer.select("BATCH_ID").unionByName(policies.select("BATCH_ID"))
            .unionByName(feed.stg_claim.select("BATCH_ID"))
        )

    count = F.count(F.lit(1))
    return match_row_counts(stacked(feed.stg_policy).agg(count.alias("SOURCE_ROWS")),
                            stacked(landed).agg(count.alias("STAGED_ROWS")), tolerance=5)


_COUNT_METRICS = (
    "SELECT CASE WHEN abs(s - t) <= {tol} THEN 'PASS' ELSE 'FAIL' END AS status, "
    "CAST(s AS BIGINT) AS source_row_count, CAST(t AS BIGINT) AS target_row_count, "
    "CAST(CASE WHEN abs(s - t) <= {tol} THEN least(s, t) ELSE 0 END AS BIGINT) "
    "AS matched_record_count, CAST(CASE WHEN abs(s - t) <= {tol} THEN 0 ELSE 1 END AS BIGINT) "
    "AS failed_record_count, false AS truncated FROM (SELECT ({s}) AS s, ({t}) AS t)"
)
_TYPED_ORDERS = (
    "SELECT o_orderkey AS O_ORDERKEY, o_custkey AS O_CUSTKEY, o_orderstatus AS O_ORDERSTATUS, "
    "CAST(o_totalprice AS DECIMAL(12,2)) AS O_TOTALPRICE, CAST(o_orderdate AS DATE) "
    "AS O_ORDERDATE FROM orders"
)
_TEXT_ORDERS = (
    "SELECT CAST(O_ORDERKEY AS VARCHAR) AS O_ORDERKEY, ' ' || O_CUSTKEY AS O_CUSTKEY, "
    "O_ORDERSTATUS || chr(9) || ' ' AS O_ORDERSTATUS, CAST(O_TOTALPRICE AS VARCHAR) || '00' "
    "AS O_TOTALPRICE, CASE WHEN day(O_ORDERDATE) = 23 THEN strftime(O_ORDERDATE, '%d/%m/%Y') "
    "WHEN day(O_ORDERDATE) = 19 THEN CAST(O_ORDERDATE AS VARCHAR) || 'T00:00' "
    "ELSE CAST(O_ORDERDATE AS VARCHAR) END AS O_ORDERDATE FROM typed"
)
_LINES = (
    "SELECT l_orderkey AS L_ORDERKEY, l_linenumber AS L_LINENUMBER, CAST(l_quantity AS BIGINT) "
    "AS L_QUANTITY, CAST(l_extendedprice AS DECIMAL(12,2)) AS L_EXTENDEDPRICE, "
    "l_returnflag AS L_RETURNFLAG, CAST(l_shipdate AS DATE) AS L_SHIPDATE FROM lineitem"
)
_LINE_COLS = {"L_QUANTITY": "int", "L_EXTENDEDPRICE": "num", "L_RETURNFLAG": "text",
              "L_SHIPDATE": "date"}
_LINE_TGT = (
    "SELECT * REPLACE (CASE WHEN day(L_SHIPDATE) = 23 THEN '?' ELSE L_RETURNFLAG END "
    "AS L_RETURNFLAG) FROM src WHERE day(L_SHIPDATE) <> 13"
)


def _near_sql() -> str:
    return sql.reconcile(
        "", _ORDER_KEYS, {"O_TOTALPRICE": "num"}, tolerance="0.01",
        base=_ORDER_SRC, src="SELECT O_ORDERKEY, O_TOTALPRICE FROM base",
        tgt="SELECT O_ORDERKEY, CAST(O_TOTALPRICE + CASE day(O_ORDERDATE) WHEN 23 THEN 0.01 "
            "WHEN 19 THEN -0.02 ELSE 0 END AS DECIMAL(12,2)) AS O_TOTALPRICE FROM base",
    )


def _text_sql() -> str:
    return sql.reconcile(
        "", {"O_ORDERKEY": "text"},
        {"O_CUSTKEY": "text", "O_ORDERSTATUS": "text", "O_TOTALPRICE": "text",
         "O_ORDERDATE": "text"},
        same={"O_CUSTKEY": "CAST(trim(s.O_CUSTKEY) AS BIGINT) = CAST(t.O_CUSTKEY AS BIGINT)",
              "O_ORDERSTATUS": "trim(s.O_ORDERSTATUS, ' ' || chr(9)) = t.O_ORDERSTATUS",
              "O_TOTALPRICE": "CAST(s.O_TOTALPRICE AS DECIMAL(18,4)) = "
                              "CAST(t.O_TOTALPRICE AS DECIMAL(18,4))"},
        typed=_TYPED_ORDERS, src=_TEXT_ORDERS,
        tgt="SELECT CAST(O_ORDERKEY AS VARCHAR) AS O_ORDERKEY, CAST(O_CUSTKEY AS VARCHAR) "
            "AS O_CUSTKEY, O_ORDERSTATUS, CAST(O_TOTALPRICE AS VARCHAR) AS O_TOTALPRICE, "
            "CAST(O_ORDERDATE AS VARCHAR) AS O_ORDERDATE FROM typed",
    )


# ---------------------------------------------------------------- rules
def blank_ids(feed: Feed) -> DataFrame:
    day = F.dayofmonth("ISSUE_DATE")
    spoiled = feed.stg_policy.withColumn(
        "POLICY_ID", F.when(day == BLANK, "   ").when(day == LOST, F.lit(None))
        .otherwise(F.col("POLICY_ID")))
    return rule_failures(rules.blank_key(spoiled, "POLICY_ID"), "Policy ID is mandatory")


def double_load(feed: Feed) -> DataFrame:
    twice = feed.stg_policy.unionByName(
        feed.stg_policy.filter(F.dayofmonth("ISSUE_DATE") == TWICE))
    return rule_failures(rules.repeated_key(twice, "POLICY_ID"), "Duplicate policy check")


def unknown_policy(feed: Feed) -> DataFrame:
    """Claims whose policy is neither among the first batch's nor in curated."""
    first = feed.stg_policy.filter(F.col("BATCH_ID") == "BATCH_1996")
    rows = rules.claim_without_policy(feed.stg_claim, first, feed.policy_master)
    return rule_failures(rows, "Claim references an existing policy")


def named(build, name: str):
    return lambda feed: rule_failures(build(feed), name)


def spoiled_trn_policy(feed: Feed) -> DataFrame:
    day = F.dayofmonth("ISSUE_DATE")
    return feed.trn_policy.withColumns({
        "POLICY_TYPE_DESC": F.when(day == WRONG, "Motor").when(day == BLANK, F.lit(None))
        .otherwise(F.col("POLICY_TYPE_DESC")),
        "POLICY_TERM_DAYS": F.when(day == TWICE, 0).otherwise(F.col("POLICY_TERM_DAYS")),
        "EXPIRY_DATE": F.when(day == FOREIGN, F.date_sub("ISSUE_DATE", 1))
        .otherwise(F.col("EXPIRY_DATE")),
    })


_SPOILED_POLICY = (
    "SELECT * REPLACE (CASE day(ISSUE_DATE) WHEN 23 THEN 'Motor' WHEN 5 THEN NULL "
    "ELSE POLICY_TYPE_DESC END AS POLICY_TYPE_DESC, CASE WHEN day(ISSUE_DATE) = 19 THEN 0 "
    "ELSE POLICY_TERM_DAYS END AS POLICY_TERM_DAYS, CASE WHEN day(ISSUE_DATE) = 17 "
    "THEN ISSUE_DATE - 1 ELSE EXPIRY_DATE END AS EXPIRY_DATE) FROM trn_policy"
)


def spoiled_ratio(feed: Feed) -> DataFrame:
    day = F.dayofmonth("CLAIM_DATE")
    step = F.lit("0.0002").cast("decimal(10,4)")
    trn = feed.trn_claim.withColumn(
        "CLAIM_RATIO", F.when(day == WRONG, F.col("CLAIM_RATIO") + step)
        .when(day == BLANK, F.lit(None)).otherwise(F.col("CLAIM_RATIO")).cast("decimal(10,4)"))
    return rules.wrong_ratio(feed.stg_claim, trn)


def emails(feed: Feed) -> DataFrame:
    """Transformed customers of one segment kept their raw address; some lost the dot."""
    raw = feed.stg_customer.select("CUSTOMER_ID", F.col("EMAIL").alias("_raw"))
    trn = feed.trn_customer.join(raw, "CUSTOMER_ID").withColumn(
        "EMAIL",
        F.when(F.col("LOCATION_DESC") == "New-Household", F.col("_raw"))
        .when(F.col("LOCATION_DESC") == "New-Machinery", F.translate("EMAIL", ".", "_"))
        .otherwise(F.col("EMAIL")))
    return rules.nonstandard_email(trn)


def packed(feed: Feed) -> DataFrame:
    """Five row-level rules over the line items in one scan."""
    items = feed.table("lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    whole = F.col("l_quantity").cast("bigint")
    ship = F.col("l_shipdate").cast("date")
    return pack(items, [
        RowRule("R1", F.col("l_quantity") > 48, key, "l_quantity", "at most 48", whole,
                "Quantity too large"),
        RowRule("R2", price < 2000, key, "l_extendedprice", "2000 or more",
                price, "Price too small"),
        RowRule("R3", F.col("l_tax") > F.col("l_discount") + 0.07, key, "l_tax",
                "within 7 points of the discount", F.col("l_linestatus"), "Tax above discount"),
        RowRule("R4", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), key,
                "l_returnflag", "A or N", F.col("l_returnflag"), "Open line was returned"),
        RowRule("R5", F.dayofmonth(ship) == LOST, key, "l_shipdate",
                "not on the 13th", ship, "Nothing ships on the 13th"),
    ])


_PACK_KEY = "l_orderkey || '-' || l_linenumber"
_PACK = [
    ("R1", "l_quantity > 48", "l_quantity", "at most 48", "CAST(l_quantity AS BIGINT)",
     "Quantity too large"),
    ("R2", "CAST(l_extendedprice AS DECIMAL(12,2)) < 2000", "l_extendedprice", "2000 or more",
     "CAST(l_extendedprice AS DECIMAL(12,2))", "Price too small"),
    ("R3", "l_tax > l_discount + 0.07::DOUBLE", "l_tax", "within 7 points of the discount",
     "l_linestatus", "Tax above discount"),
    ("R4", "l_returnflag = 'R' AND l_linestatus = 'O'", "l_returnflag", "A or N", "l_returnflag",
     "Open line was returned"),
    ("R5", "day(l_shipdate) = 13", "l_shipdate", "not on the 13th", "CAST(l_shipdate AS DATE)",
     "Nothing ships on the 13th"),
]


def generic_detail(feed: Feed) -> DataFrame:
    """A rule without recognised columns: first column is the key, the row is the reason."""
    rows = feed.table("orders").filter(F.col("o_totalprice") < 5000).select(
        "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o_orderdate"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("prio"),
    )
    return rule_failures(rows, "Small orders")


def status_events(feed: Feed):
    rows = feed.table("events").select(
        F.col("event_id").alias("ID"),
        F.when(F.col("event_type") == "click", " ok ").when(F.col("event_type") == "signup", "true")
        .when(F.col("event_type") == "purchase", "1").when(F.col("event_type") == "error", "bad")
        .alias("RESULT"),
    )
    return status_column(rows, "Event states")


def region_report(feed: Feed):
    """Reporting only: customers per region; never fails."""
    rows = feed.table("customer").join(
        feed.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).join(feed.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return informational(rows.groupBy("r_name").agg(F.count(F.lit(1)).alias("n")), "Regions")


def queries() -> dict:
    orders = {"base": _ORDER_SRC, "src": "SELECT * FROM base", "tgt": _ORDER_TGT}
    reason = "'Policy id is null or blank'"
    return {
        "reconcile_orders": (lambda f: orders_check(f).failures,
                             sql.reconcile("", _ORDER_KEYS, _ORDER_COLS, **orders)),
        "reconcile_metrics": (lambda f: orders_check(f).metrics,
                              sql.reconcile("", _ORDER_KEYS, _ORDER_COLS, metrics=True, **orders)),
        "reconcile_tolerance": (lambda f: near_prices(f).failures, _near_sql()),
        "reconcile_text_vs_typed": (lambda f: text_orders(f).failures, _text_sql()),
        "reconcile_composite_key": (
            lambda f: composite_key(f).failures,
            sql.reconcile("", {"L_ORDERKEY": "int", "L_LINENUMBER": "int"}, _LINE_COLS,
                          src=_LINES, tgt=_LINE_TGT)),
        "reconcile_screened": (
            lambda f: composite_key(f, reconcile_screened).failures,
            sql.reconcile("", {"L_ORDERKEY": "int", "L_LINENUMBER": "int"}, _LINE_COLS,
                          src=_LINES, tgt=_LINE_TGT)),
        "reconcile_screened_metrics": (
            lambda f: orders_check(f, reconcile_screened).metrics,
            sql.reconcile("", _ORDER_KEYS, _ORDER_COLS, metrics=True, **orders)),
        "duplicate_keys": (
            lambda f: duplicate_keys(f.table("lineitem"), ["l_orderkey", "l_linenumber"]),
            "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem "
            "GROUP BY ALL HAVING count(*) > 1"),
        "row_count_match": (
            lambda f: count_match(f).metrics,
            sql.using("policy_master", _COUNT_METRICS.format(
                tol=0, s="SELECT count(*) FROM stg_policy",
                t="SELECT count(*) FROM policy_master"))),
        "row_count_failures": (
            lambda f: count_match(f).failures,
            sql.using("policy_master",
                      "SELECT '<row count>' AS business_key, 'ROW_COUNT' AS column_name, "
                      "CAST(s AS VARCHAR) AS expected_value, CAST(t AS VARCHAR) AS actual_value, "
                      "'ROW_COUNT_MISMATCH' AS failure_type, 'Source returned ' || s || "
                      "' row(s), target returned ' || t AS failure_reason FROM (SELECT "
                      "(SELECT count(*) FROM stg_policy) AS s, (SELECT count(*) FROM "
                      "policy_master) AS t) WHERE s <> t")),
        "file_to_stage_count": (
            lambda f: file_to_stage(f).metrics,
            sql.using("stg_customer stg_policy stg_claim", _COUNT_METRICS.format(
                tol=5,
                s="SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + "
                  "(SELECT count(*) FROM lineitem)",
                t="SELECT (SELECT count(*) FROM stg_customer) + (SELECT count(*) FROM stg_policy "
                  "WHERE day(ISSUE_DATE) <> 13) + (SELECT count(*) FROM stg_claim)"))),
        "rule_mandatory_key": (blank_ids, sql.violations(
            "stg_policy", "spoiled WHERE POLICY_ID IS NULL OR trim(POLICY_ID) = ''",
            "coalesce(POLICY_ID, '<NULL>')", "POLICY_ID", "'a non-null policy id'", "POLICY_ID",
            reason, spoiled="SELECT * REPLACE (CASE day(ISSUE_DATE) WHEN 5 THEN '   ' "
                            "WHEN 13 THEN NULL ELSE POLICY_ID END AS POLICY_ID) FROM stg_policy")),
        "rule_duplicate_policy": (double_load, sql.violations(
            "stg_policy", "dup", "POLICY_ID", "POLICY_ID", "'1'", "CAST(n AS VARCHAR)",
            "'Policy id appears more than once in the batch'",
            dup="SELECT POLICY_ID, count(*) AS n FROM (SELECT POLICY_ID FROM stg_policy UNION ALL "
                "SELECT POLICY_ID FROM stg_policy WHERE day(ISSUE_DATE) = 19) "
                "GROUP BY POLICY_ID HAVING count(*) > 1")),
        "rule_unknown_policy": (unknown_policy, sql.violations(
            "stg_claim policy_master",
            "stg_claim c WHERE NOT EXISTS (SELECT 1 FROM stg_policy p WHERE p.POLICY_ID = "
            "c.POLICY_ID AND p.BATCH_ID = 'BATCH_1996') AND NOT EXISTS (SELECT 1 FROM "
            "policy_master m WHERE m.POLICY_ID = c.POLICY_ID)",
            "CLAIM_ID", "POLICY_ID", "'an existing policy id'", "POLICY_ID",
            "'Claim references a policy that is neither in the batch nor in curated'")),
        "rule_amount_range": (
            named(lambda f: rules.approved_out_of_range(f.stg_claim), "Approved amount"),
            sql.violations(
                "stg_claim", "stg_claim WHERE APPROVED_AMOUNT < 0 OR "
                "APPROVED_AMOUNT > CLAIM_AMOUNT", "CLAIM_ID", "APPROVED_AMOUNT",
                "'0 .. ' || CAST(CLAIM_AMOUNT AS VARCHAR)", "CAST(APPROVED_AMOUNT AS VARCHAR)",
                "'Approved amount is negative or exceeds the claim amount'")),
        "rule_type_decode": (
            named(lambda f: rules.wrong_type_decode(f.stg_policy, spoiled_trn_policy(f)), "Decode"),
            sql.violations(
                "trn_policy", "(SELECT s.POLICY_ID, g.POLICY_TYPE_DESC AS want, "
                "t.POLICY_TYPE_DESC AS got FROM stg_policy s JOIN spoiled t ON t.POLICY_ID = "
                "s.POLICY_ID AND t.BATCH_ID = s.BATCH_ID JOIN trn_policy g ON g.POLICY_ID = "
                "s.POLICY_ID) WHERE got <> want", "POLICY_ID", "POLICY_TYPE_DESC", "want", "got",
                "'Policy type was not decoded per the mapping rule'", spoiled=_SPOILED_POLICY)),
        "rule_term_validity": (
            named(lambda f: rules.invalid_term(spoiled_trn_policy(f)), "Term"),
            sql.violations(
                "trn_policy", "spoiled WHERE EXPIRY_DATE < ISSUE_DATE OR POLICY_TERM_DAYS <> "
                "EXPIRY_DATE - ISSUE_DATE", "POLICY_ID", "POLICY_TERM_DAYS",
                "CAST(EXPIRY_DATE - ISSUE_DATE AS VARCHAR)", "CAST(POLICY_TERM_DAYS AS VARCHAR)",
                "'Expiry precedes issue date, or the derived term is wrong'",
                spoiled=_SPOILED_POLICY)),
        "rule_ratio_derivation": (named(spoiled_ratio, "Ratio"), sql.violations(
            "trn_claim", "(SELECT g.CLAIM_ID, g.CLAIM_RATIO AS want, CASE day(g.CLAIM_DATE) "
            "WHEN 23 THEN CAST(g.CLAIM_RATIO + 0.0002 AS DECIMAL(10,4)) WHEN 5 THEN NULL "
            "ELSE g.CLAIM_RATIO END AS got FROM trn_claim g) WHERE "
            "abs(coalesce(got, 0) - want) > 0.0001 OR got NOT BETWEEN 0 AND 1",
            "CLAIM_ID", "CLAIM_RATIO", "CAST(want AS VARCHAR)", "CAST(got AS VARCHAR)",
            "'Claim ratio does not match approved / claimed, or is outside 0..1'")),
        "rule_email_standard": (named(emails, "Email"), sql.violations(
            "trn_customer", "(SELECT t.CUSTOMER_ID, CASE t.LOCATION_DESC WHEN 'New-Household' "
            "THEN s.EMAIL WHEN 'New-Machinery' THEN replace(t.EMAIL, '.', '_') ELSE t.EMAIL END "
            "AS e FROM trn_customer t JOIN stg_customer s ON s.CUSTOMER_ID = t.CUSTOMER_ID) "
            "WHERE e <> lower(trim(e)) OR e NOT LIKE '%@%.%'",
            "CUSTOMER_ID", "EMAIL", "lower(trim(e))", "e",
            "'Email is not lower-cased/trimmed, or is not a valid address'")),
        "rule_packed": (packed, " UNION ALL ".join(
            f"SELECT '{i}' AS test_id, {_PACK_KEY} AS business_key, '{c}' AS column_name, "
            f"'{e}' AS expected_value, CAST({a} AS VARCHAR) AS actual_value, "
            f"'RULE_VIOLATION' AS failure_type, '{r}' AS failure_reason FROM lineitem WHERE {w}"
            for i, w, c, e, a, r in _PACK)),
        "rule_generic_detail": (generic_detail, (
            "SELECT CAST(o_orderkey AS VARCHAR) AS business_key, 'o_orderstatus' AS column_name, "
            "'' AS expected_value, '' AS actual_value, 'RULE_VIOLATION' AS failure_type, "
            "'Small orders: o_orderkey=' || o_orderkey || ', o_orderstatus=' || o_orderstatus || "
            "', o_orderdate=' || CAST(o_orderdate AS DATE) || ', prio=' || CASE WHEN "
            "o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '<NULL>' END AS failure_reason "
            "FROM orders WHERE o_totalprice < 5000")),
        "status_column_check": (lambda f: status_events(f).failures, (
            "SELECT CAST(event_id AS VARCHAR) AS business_key, 'RESULT' AS column_name, "
            "'' AS expected_value, '' AS actual_value, 'RULE_VIOLATION' AS failure_type, "
            "'Event states: ID=' || event_id || ', RESULT=' || CASE event_type WHEN 'error' "
            "THEN 'bad' ELSE '<NULL>' END AS failure_reason FROM events "
            "WHERE event_type IN ('error', 'view')")),
        "status_column_metrics": (lambda f: status_events(f).metrics, (
            "SELECT CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END AS status, "
            "n AS source_row_count, CAST(0 AS BIGINT) AS target_row_count, "
            "n - bad AS matched_record_count, bad AS failed_record_count, bad > 1000 AS truncated "
            "FROM (SELECT count(*) AS n, count(*) FILTER (WHERE event_type IN ('error', 'view')) "
            "AS bad FROM events)")),
        "zero_rows_metrics": (
            lambda f: no_rows(rules.approved_out_of_range(f.stg_claim), "x").metrics,
            sql.using("stg_claim",
                      "SELECT CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, "
                      "n AS source_row_count, CAST(0 AS BIGINT) AS target_row_count, "
                      "CAST(0 AS BIGINT) AS matched_record_count, n AS failed_record_count, "
                      "n > 1000 AS truncated FROM (SELECT count(*) AS n FROM stg_claim WHERE "
                      "APPROVED_AMOUNT < 0 OR APPROVED_AMOUNT > CLAIM_AMOUNT)")),
        "informational_report": (lambda f: region_report(f).frame, (
            "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey "
            "JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")),
    }

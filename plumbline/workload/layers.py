"""Mapping, curated changes, watermarks, linkage and historical queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import promotion
from plumbline.operators.counts import counts_by_layer, record_counts
from plumbline.operators.latest import latest_by, latest_version
from plumbline.operators.linkage import linked
from plumbline.operators.mutate import (
    customer_totals,
    replace_batch,
    set_where,
    update_from,
    upsert,
    with_totals,
)
from plumbline.operators.reconcile import reconcile
from plumbline.operators.rules import rule_failures
from plumbline.operators.watermark import batch_stats, next_watermark, validation_window
from plumbline.plans import mapping, rules
from plumbline.plans.runner import build
from plumbline.schemas import DQ_WATERMARK, ENTITIES, types
from plumbline.workload import sql
from plumbline.workload.feed import BATCHES, FOREIGN, LOST, TWICE, WRONG, Feed

B1, B2, B3 = BATCHES
PROCESSES = {"TRN_CUSTOMER": "CUSTOMER_CURATED_LOAD", "TRN_POLICY": "POLICY_CURATED_LOAD",
             "TRN_CLAIM": "CLAIM_CURATED_LOAD"}
# Day of the month whose rows are delivered a second time.
RESENT = {"STG_POLICY": TWICE, "STG_CLAIM": TWICE, "STG_CUSTOMER": 2}
EMPTY_STATE = ", ".join(f"{c} {t}" for c, t in types(DQ_WATERMARK).items())


def of(rows: DataFrame, *batches: str) -> DataFrame:
    return rows.filter(F.col("BATCH_ID").isin(*batches))


# ---------------------------------------------------------------- curated changes
def scd1(feed: Feed) -> DataFrame:
    """
    Curated policies after two loads: the first two batches, then a corrected
    delivery of the second (premiums up) together with the third.
    """
    first = mapping.policy_rows(of(feed.trn_policy, B1, B2))
    second = mapping.policy_rows(of(feed.trn_policy, B2, B3)).withColumn(
        "PREMIUM_AMOUNT", (F.col("PREMIUM_AMOUNT") + 5).cast("decimal(12,2)"))
    return upsert(first, second, ["POLICY_ID"])


def reload_batch(feed: Feed) -> DataFrame:
    """The second batch delivered again, without one day; the others stay."""
    again = of(feed.trn_policy, B2).filter(F.dayofmonth("ISSUE_DATE") != LOST)
    return replace_batch(feed.trn_policy, again, B2).select("POLICY_ID", "BATCH_ID",
                                                            "PREMIUM_AMOUNT")


def corrected(feed: Feed) -> DataFrame:
    """Premiums and stamps of curated policies put back to what one batch delivered."""
    good = of(feed.trn_policy, B1)
    return update_from(
        feed.policy_master, good, ["POLICY_ID"],
        {"PREMIUM_AMOUNT": "PREMIUM_AMOUNT", "LAST_UPDATED_TS": "RECORD_EFFECTIVE_TS"},
    )


def injected(feed: Feed) -> DataFrame:
    """Constants written into curated claims by condition."""
    rows = mapping.claim_rows(feed.trn_claim)
    day = F.dayofmonth("CLAIM_DATE")
    rows = set_where(rows, day == WRONG, {"CLAIM_STATUS": F.lit("Pending")})
    return set_where(rows, day == FOREIGN, {"POLICY_ID": F.lit("P9999999")}).select(
        "CLAIM_ID", "POLICY_ID", "CLAIM_STATUS")


def customer_view(feed: Feed) -> DataFrame:
    return with_totals(
        mapping.customer_rows(feed.trn_customer),
        customer_totals(feed.policy_master, feed.claim_master),
    )


# ---------------------------------------------------------------- checks on curated
def policy_vs_curated(feed: Feed):
    return reconcile(
        mapping.policy_rows(feed.trn_policy),
        linked(feed.policy_master, "POLICY_ID", feed.trn_policy),
        ["POLICY_ID"], ["POLICY_TYPE", "POLICY_STATUS", "PREMIUM_AMOUNT", "CUSTOMER_ID"])


def saved(name: str, batch: str = B1, **extra):
    """A built-in rule by name over the derived layers, for one batch."""
    def run(feed: Feed):
        rule = next(r for r in rules.builtin_rules() if r.name == name)
        tables = {**feed.tables(), **{k: make(feed) for k, make in extra.items()}}
        values = {"batch_id": batch, **rule.defaults}
        return build(feed.spark, rule, tables, values)

    return run


def totals_check(feed: Feed):
    """Recomputed totals of every customer against the stored ones."""
    return reconcile(
        customer_view(feed), feed.customer_360, ["CUSTOMER_ID"],
        ["TOTAL_PREMIUM", "TOTAL_CLAIMS", "TOTAL_CLAIM_AMOUNT"], tolerance=0.01)


def restaged(kind: str):
    """Mapping rules re-applied to staging, against curated."""
    def run(feed: Feed):
        if kind == "policy":
            return reconcile(
                mapping.policy_rows(mapping.map_policy(feed.stg_policy)), feed.policy_master,
                ["POLICY_ID"], ["CUSTOMER_ID", "POLICY_TYPE", "POLICY_STATUS", "PREMIUM_AMOUNT",
                                "ISSUE_DATE", "EXPIRY_DATE"])
        if kind == "claim":
            known = mapping.map_claim(feed.stg_claim, feed.stg_policy, feed.policy_master)
            return reconcile(
                mapping.claim_rows(known), feed.claim_master, ["CLAIM_ID"],
                ["POLICY_ID", "CLAIM_DATE", "CLAIM_STATUS", "CLAIM_AMOUNT", "APPROVED_AMOUNT",
                 "CLAIM_RATIO"])
        return reconcile(
            mapping.customer_rows(mapping.map_customer(feed.stg_customer)),
            feed.customer_360.withColumn("EMAIL", F.upper("EMAIL")), ["CUSTOMER_ID"],
            ["CUSTOMER_NAME", "EMAIL"])

    return run


# ---------------------------------------------------------------- watermarks
def marks_after(feed: Feed, *batches: str) -> DataFrame:
    """The watermark state after loading batches in the given order."""
    layers = {"TRN_CUSTOMER": feed.trn_customer, "TRN_POLICY": feed.trn_policy,
              "TRN_CLAIM": feed.trn_claim}
    state = feed.spark.createDataFrame([], EMPTY_STATE)
    for batch in batches:
        stats = batch_stats({PROCESSES[n]: of(rows, batch) for n, rows in layers.items()})
        state = next_watermark(state, stats, batch)
    return state.drop("UPDATED_TS")


def boundary(stg: str, loaded: tuple[str, ...], batch: str):
    """Rows of a batch outside its window; some rows of the previous batch are sent again."""
    key, trn, _, process = ENTITIES[stg]
    rows_of = {"TRN_POLICY": lambda f: f.trn_policy, "TRN_CLAIM": lambda f: f.trn_claim,
               "TRN_CUSTOMER": lambda f: f.trn_customer}[trn]
    dated = {"TRN_POLICY": "ISSUE_DATE", "TRN_CLAIM": "CLAIM_DATE",
             "TRN_CUSTOMER": "RECORD_EFFECTIVE_TS"}[trn]

    def run(feed: Feed) -> DataFrame:
        rows = rows_of(feed)
        resent = of(rows, B1).filter(F.dayofmonth(dated) == RESENT[stg])
        sent = of(rows, batch).unionByName(resent.withColumn("BATCH_ID", F.lit(batch)))
        found = rules.watermark_breach(
            sent, marks_after(feed, *loaded), key, process, batch)
        return rule_failures(found, "boundary")

    return run


_MARK_SQL = """
    SELECT '{process}' AS PROCESS_NAME, min(RECORD_EFFECTIVE_TS) AS lo,
           max(RECORD_EFFECTIVE_TS) AS hi, count(*) AS n, BATCH_ID AS b
    FROM {table} GROUP BY BATCH_ID"""


def _marks_sql(*batches: str) -> str:
    """For distinct batches in order: the last carried batch and the one before it."""
    order = ", ".join(f"('{b}', {i})" for i, b in enumerate(batches))
    stats = " UNION ALL ".join(
        _MARK_SQL.format(process=p, table=t.lower()) for t, p in PROCESSES.items())
    return (
        f"SELECT PROCESS_NAME, lag(hi) OVER w AS PREVIOUS_WATERMARK, "
        f"hi AS BATCH_HIGH_WATERMARK, b AS LAST_BATCH_ID, n AS ROWS_PROCESSED, "
        f"'SUCCESS' AS LOAD_STATUS, 'PENDING' AS VALIDATION_STATUS FROM ({stats}) "
        f"JOIN (VALUES {order}) o(name, pos) ON o.name = b "
        f"WINDOW w AS (PARTITION BY PROCESS_NAME ORDER BY pos) "
        f"QUALIFY row_number() OVER (PARTITION BY PROCESS_NAME ORDER BY pos DESC) = 1"
    )


def _boundary_sql(stg: str, loaded: tuple[str, ...], batch: str) -> str:
    key, trn, _, process = ENTITIES[stg]
    dated = {"TRN_POLICY": "ISSUE_DATE", "TRN_CLAIM": "CLAIM_DATE",
             "TRN_CUSTOMER": "RECORD_EFFECTIVE_TS"}[trn]
    t = trn.lower()
    stamp = "CAST({} AS VARCHAR)".format
    ts, lo, hi = (f"w.{c}" if c != "RECORD_EFFECTIVE_TS" else f"t.{c}" for c in
                  ("RECORD_EFFECTIVE_TS", "PREVIOUS_WATERMARK", "BATCH_HIGH_WATERMARK"))
    sent = (f"SELECT {key}, RECORD_EFFECTIVE_TS, BATCH_ID FROM {t} WHERE BATCH_ID = '{batch}' "
            f"UNION ALL SELECT {key}, RECORD_EFFECTIVE_TS, '{batch}' FROM {t} "
            f"WHERE BATCH_ID = '{B1}' AND day({dated}) = {RESENT[stg]}")
    old = "Not newer than the previous batch''s watermark: already-processed data sent again"
    body = (
        f"SELECT {key} AS business_key, 'RECORD_EFFECTIVE_TS' AS column_name, "
        f"coalesce('after ' || {stamp(lo)}, 'no lower bound') || ', up to ' || {stamp(hi)} "
        f"AS expected_value, {stamp(ts)} AS actual_value, 'RULE_VIOLATION' AS failure_type, "
        f"CASE WHEN {ts} <= {lo} THEN '{old}' ELSE 'Later than the high watermark committed for "
        f"the batch' END AS failure_reason FROM sent t JOIN marks w ON w.PROCESS_NAME = "
        f"'{process}' AND w.LAST_BATCH_ID = t.BATCH_ID WHERE {ts} <= {lo} OR {ts} > {hi} "
        f"UNION ALL SELECT '{batch}', 'LAST_BATCH_ID', '{batch}', "
        f"coalesce(max(w.LAST_BATCH_ID), '<no watermark>'), 'RULE_VIOLATION', "
        f"'The {process} watermark was not committed for this batch' FROM sent t LEFT JOIN marks "
        f"w ON w.PROCESS_NAME = '{process}' HAVING count(*) > 0 AND "
        f"max(CASE WHEN w.LAST_BATCH_ID = '{batch}' THEN 1 ELSE 0 END) = 0"
    )
    return sql.using("trn_customer trn_policy trn_claim", body, marks=_marks_sql(*loaded),
                     sent=sent)


# ---------------------------------------------------------------- historical
DAYS = ("1997-07-01", "1998-12-31")


def _best() -> list:
    """Which of several rows of one (claim, stamp) counts."""
    return [F.col(c).desc_nulls_last() for c in (
        "CLAIM_AMOUNT", "CUSTOMER_ID", "APPROVED_AMOUNT", "CLAIM_STATUS", "INCIDENT_TYPE")]


def claim_history(feed: Feed) -> DataFrame:
    """Every delivered version of every claim, one per (claim, stamp)."""
    return mapping.map_claim(latest_by(feed.claim_versions, ["CLAIM_ID", "LAST_UPDATED_TS"], _best()))


def latest_claims(feed: Feed) -> DataFrame:
    """Each claim's latest version, picked in one ranking by stamp and then as in ``claim_history``."""
    order = [F.col("LAST_UPDATED_TS").desc_nulls_last(), *_best()]
    return mapping.map_claim(latest_by(feed.claim_versions, ["CLAIM_ID"], order))


def historical_claims(feed: Feed):
    """
    Latest version first, date window second, against curated in the same window.
    Curated never received the last batch, and one day's statuses are wrong.
    """
    versions = claim_history(feed)
    source = mapping.claim_rows(latest_claims(feed).filter(
        rules.in_days(F.col("RECORD_EFFECTIVE_TS"), *DAYS)))
    curated = mapping.claim_rows(latest_version(of(versions, B1, B2), "CLAIM_ID"))
    target = curated.filter(rules.in_days(F.col("LAST_UPDATED_TS"), *DAYS)).withColumn(
        "CLAIM_STATUS", F.when(F.dayofmonth("CLAIM_DATE") == WRONG, "Pending")
        .otherwise(F.col("CLAIM_STATUS")))
    return reconcile(source, target, ["CLAIM_ID"],
                     ["POLICY_ID", "CLAIM_STATUS", "CLAIM_AMOUNT", "APPROVED_AMOUNT"])


def historical_policies(feed: Feed):
    source = mapping.policy_rows(rules.latest_in_window(feed.trn_policy, "POLICY_ID", *DAYS))
    target = feed.policy_master.filter(rules.in_days(F.col("LAST_UPDATED_TS"), *DAYS))
    return reconcile(source, target, ["POLICY_ID"],
                     ["CUSTOMER_ID", "POLICY_TYPE", "POLICY_STATUS", "PREMIUM_AMOUNT"])


def historical_customers(feed: Feed):
    days = ("1995-06-01", "1995-06-01")
    source = mapping.customer_rows(rules.latest_in_window(feed.trn_customer, "CUSTOMER_ID", *days))
    target = feed.customer_360.filter(rules.in_days(F.col("LAST_UPDATED_TS"), *days)).withColumn(
        "EMAIL", F.when(F.col("CUSTOMER_NAME") == "UNKNOWN", F.lit(None))
        .otherwise(F.col("EMAIL")))
    return reconcile(source, target, ["CUSTOMER_ID"], ["CUSTOMER_NAME", "EMAIL"])


def batch_staged(feed: Feed, batch: str) -> dict[str, DataFrame]:
    return {"STG_CUSTOMER": of(feed.stg_customer, batch), "STG_POLICY": of(feed.stg_policy, batch),
            "STG_CLAIM": of(feed.claim_versions, batch)}


def batch_window(feed: Feed) -> DataFrame:
    return validation_window([of(feed.trn_customer, B1), of(feed.trn_policy, B1),
                              of(feed.trn_claim, B1)])


def regression_copies(feed: Feed) -> DataFrame:
    """The four regression copies run as one suite over the derived layers, failures together."""
    copies = [r for r in rules.builtin_rules() if r.folder == "/Regression"]
    tables = feed.tables()
    parts = [
        build(feed.spark, r, tables, {"batch_id": B2}).failures.groupBy("failure_type").agg(
            F.lit(r.name).alias("test_name"), F.count(F.lit(1)).alias("failures"))
        for r in copies
    ]
    return reduce(DataFrame.unionByName, parts)


_POLICY_COLS = {"POLICY_TYPE": "text", "POLICY_STATUS": "text", "PREMIUM_AMOUNT": "num",
                "CUSTOMER_ID": "text"}
_CLAIM_COLS = {"POLICY_ID": "text", "CLAIM_STATUS": "text", "CLAIM_AMOUNT": "num",
               "APPROVED_AMOUNT": "num", "CLAIM_RATIO": "num"}
_POLICY_SRC = ("SELECT POLICY_ID, CUSTOMER_ID, POLICY_TYPE_DESC AS POLICY_TYPE, "
               "POLICY_STATUS_DESC AS POLICY_STATUS, PREMIUM_AMOUNT, ISSUE_DATE, EXPIRY_DATE, "
               "RECORD_EFFECTIVE_TS, BATCH_ID FROM trn_policy")
_CLAIM_SRC = ("SELECT CLAIM_ID, POLICY_ID, CLAIM_STATUS_DESC AS CLAIM_STATUS, CLAIM_AMOUNT, "
              "APPROVED_AMOUNT, CLAIM_RATIO, CLAIM_DATE, RECORD_EFFECTIVE_TS, BATCH_ID "
              "FROM trn_claim")
_ID = {"text": "text"}
_IN_DAYS = "{c} >= TIMESTAMP '1997-07-01' AND {c} < TIMESTAMP '1999-01-01'"
_ORPHANS = ("Curated claim points at a policy that does not exist",
            "a policy present in POLICY_MASTER")


def _batch_scope(table: str, trn: str, key: str, batch: str) -> str:
    return (f"SELECT * FROM {table} WHERE {key} IN "
            f"(SELECT {key} FROM {trn} WHERE BATCH_ID = '{batch}')")


def _counts_sql(batch: str) -> str:
    parts = []
    for layer, prefix in (("Staging", "stg"), ("Transformation", "trn")):
        for e in ("customer", "policy", "claim"):
            t = f"{prefix}_{e}"
            parts.append(f"SELECT '{layer}' AS layer, '{t.upper()}' AS table_name, count(*) AS "
                         f"total_rows, count(*) FILTER (WHERE BATCH_ID = '{batch}') "
                         f"AS batch_rows FROM {t}")
    for t, trn, key in (("customer_360", "trn_customer", "CUSTOMER_ID"),
                        ("policy_master", "trn_policy", "POLICY_ID"),
                        ("claim_master", "trn_claim", "CLAIM_ID")):
        parts.append(f"SELECT 'Curated', '{t.upper()}', count(*), count(*) FILTER (WHERE {key} IN "
                     f"(SELECT {key} FROM {trn} WHERE BATCH_ID = '{batch}')) FROM {t}")
    return " UNION ALL ".join(parts)


_LAYERS = "stg_customer stg_policy stg_claim trn_customer trn_policy trn_claim customer_360"


def queries() -> dict:
    trn_customer = "CUSTOMER_ID, CUSTOMER_NAME, EMAIL, LOCATION_DESC, BATCH_ID, RECORD_EFFECTIVE_TS"
    stale = {"POLICY_ID": "text"}
    version_cols = ("CLAIM_ID", "CLAIM_AMOUNT", "RECORD_EFFECTIVE_TS", "BATCH_ID")
    history = ("SELECT * FROM claim_versions QUALIFY row_number() OVER (PARTITION BY CLAIM_ID, "
               "LAST_UPDATED_TS ORDER BY CLAIM_AMOUNT DESC NULLS LAST, CUSTOMER_ID DESC NULLS "
               "LAST, APPROVED_AMOUNT DESC NULLS LAST, CLAIM_STATUS DESC NULLS LAST, "
               "INCIDENT_TYPE DESC NULLS LAST) = 1")
    newest = (f"SELECT * FROM ({sql.CTES['trn_claim'].replace('FROM stg_claim', 'FROM history')}) "
              "QUALIFY row_number() OVER (PARTITION BY CLAIM_ID ORDER BY RECORD_EFFECTIVE_TS DESC "
              "NULLS LAST, BATCH_ID DESC NULLS LAST) = 1")
    loaded = newest.replace("FROM history", f"FROM history WHERE BATCH_ID <> '{B3}'")
    later = (B1, B2)
    return {
        "map_customer": (lambda f: f.trn_customer,
                         sql.using("trn_customer", f"SELECT {trn_customer} FROM trn_customer")),
        "map_policy": (lambda f: f.trn_policy,
                       sql.using("trn_policy", "SELECT * FROM trn_policy")),
        "map_claim": (lambda f: f.trn_claim, sql.using("trn_claim", "SELECT * FROM trn_claim")),
        "linked_claims": (
            lambda f: mapping.map_claim(of(f.stg_claim, B2), of(f.stg_policy, B2),
                                        f.policy_master).select("CLAIM_ID", "POLICY_ID"),
            sql.using("stg_claim policy_master", (
                f"SELECT CLAIM_ID, POLICY_ID FROM stg_claim s WHERE BATCH_ID = '{B2}' AND (EXISTS "
                f"(SELECT 1 FROM stg_policy p WHERE p.POLICY_ID = s.POLICY_ID AND p.BATCH_ID = "
                f"'{B2}') OR EXISTS (SELECT 1 FROM policy_master m "
                f"WHERE m.POLICY_ID = s.POLICY_ID))"))),
        "dropped_claims": (
            lambda f: promotion.dropped_claims(of(f.stg_claim, B2), of(f.stg_policy, B2),
                                               f.policy_master),
            sql.using("stg_claim policy_master", (
                f"SELECT CLAIM_ID, POLICY_ID FROM stg_claim s WHERE BATCH_ID = '{B2}' AND NOT "
                f"EXISTS (SELECT 1 FROM stg_policy p WHERE p.POLICY_ID = s.POLICY_ID AND "
                f"p.BATCH_ID = '{B2}') AND NOT EXISTS (SELECT 1 FROM policy_master m "
                f"WHERE m.POLICY_ID = s.POLICY_ID)"))),
        "promotion_duplicates": (
            lambda f: promotion.repeated_keys(batch_staged(f, B2)),
            sql.using("stg_customer stg_policy claim_versions", " UNION ALL ".join(
                f"SELECT '{n}' AS table_name, {k} AS business_key, count(*) AS n_rows FROM {t} "
                f"WHERE BATCH_ID = '{B2}' GROUP BY {k} HAVING count(*) > 1"
                for n, t, k in (("STG_CUSTOMER", "stg_customer", "CUSTOMER_ID"),
                                ("STG_POLICY", "stg_policy", "POLICY_ID"),
                                ("STG_CLAIM", "claim_versions", "CLAIM_ID"))))),
        "staged_counts": (
            lambda f: promotion.staged_counts(batch_staged(f, B2)),
            sql.using("stg_customer stg_policy claim_versions", " UNION ALL ".join(
                f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {t} WHERE BATCH_ID = '{B2}'"
                for n, t in (("STG_CUSTOMER", "stg_customer"), ("STG_POLICY", "stg_policy"),
                             ("STG_CLAIM", "claim_versions"))))),
        "customer_360": (customer_view, sql.using("true_360", "SELECT * FROM true_360")),
        "customer_360_reconcile": (
            lambda f: totals_check(f).failures,
            sql.reconcile("customer_360", {"CUSTOMER_ID": "text"},
                          {"TOTAL_PREMIUM": "num", "TOTAL_CLAIMS": "int",
                           "TOTAL_CLAIM_AMOUNT": "num"}, tolerance="0.01",
                          src="SELECT * FROM true_360", tgt="SELECT * FROM customer_360")),
        "customer_360_batch_check": (
            lambda f: saved("Customer 360 aggregate reconciliation", B2)(f).metrics,
            sql.reconcile(
                "customer_360", {"CUSTOMER_ID": "text"},
                {"TOTAL_PREMIUM": "num", "TOTAL_CLAIMS": "int", "TOTAL_CLAIM_AMOUNT": "num"},
                metrics=True, tolerance="0.01",
                touched=f"SELECT CUSTOMER_ID FROM trn_customer WHERE BATCH_ID = '{B2}' UNION "
                        f"SELECT CUSTOMER_ID FROM trn_policy WHERE BATCH_ID = '{B2}' UNION "
                        "SELECT p.CUSTOMER_ID FROM trn_claim t JOIN policy_master p ON "
                        f"p.POLICY_ID = t.POLICY_ID WHERE t.BATCH_ID = '{B2}'",
                src="SELECT * FROM true_360 WHERE CUSTOMER_ID IN (FROM touched)",
                tgt="SELECT * FROM customer_360 WHERE CUSTOMER_ID IN (FROM touched)")),
        "policy_vs_curated": (
            lambda f: policy_vs_curated(f).failures,
            sql.reconcile("policy_master", stale, _POLICY_COLS, src=_POLICY_SRC,
                          tgt="SELECT * FROM policy_master")),
        "policy_batch_vs_curated": (
            lambda f: saved("Policy transformation vs curated", B2)(f).failures,
            sql.reconcile("policy_master", stale, _POLICY_COLS,
                          src=f"{_POLICY_SRC} WHERE BATCH_ID = '{B2}'",
                          tgt=_batch_scope("policy_master", "trn_policy", "POLICY_ID", B2))),
        "claim_batch_vs_curated": (
            lambda f: saved("Claim transformation vs curated", B2)(f).failures,
            sql.reconcile("claim_master", {"CLAIM_ID": "text"}, _CLAIM_COLS,
                          src=f"{_CLAIM_SRC} WHERE BATCH_ID = '{B2}'",
                          tgt=_batch_scope("claim_master", "trn_claim", "CLAIM_ID", B2))),
        "staging_vs_curated_policy": (
            lambda f: restaged("policy")(f).failures,
            sql.reconcile("policy_master", stale, {
                "CUSTOMER_ID": "text", "POLICY_TYPE": "text", "POLICY_STATUS": "text",
                "PREMIUM_AMOUNT": "num", "ISSUE_DATE": "date", "EXPIRY_DATE": "date"},
                src=_POLICY_SRC, tgt="SELECT * FROM policy_master")),
        "staging_vs_curated_claim": (
            lambda f: restaged("claim")(f).failures,
            sql.reconcile("claim_master policy_master", {"CLAIM_ID": "text"}, {
                "POLICY_ID": "text", "CLAIM_DATE": "date", "CLAIM_STATUS": "text",
                "CLAIM_AMOUNT": "num", "APPROVED_AMOUNT": "num", "CLAIM_RATIO": "num"},
                src=f"{_CLAIM_SRC} WHERE POLICY_ID IN (SELECT POLICY_ID FROM stg_policy UNION "
                    "SELECT POLICY_ID FROM policy_master)",
                tgt="SELECT * FROM claim_master")),
        "saved_policy_staging_rule": (
            lambda f: saved("Policy staging vs curated (mapping rules)", B2)(f).failures,
            sql.reconcile("policy_master", stale, {
                "CUSTOMER_ID": "text", "POLICY_TYPE": "text", "POLICY_STATUS": "text",
                "PREMIUM_AMOUNT": "num", "ISSUE_DATE": "date", "EXPIRY_DATE": "date"},
                src=f"{_POLICY_SRC} WHERE BATCH_ID = '{B2}'",
                tgt=_batch_scope("policy_master", "trn_policy", "POLICY_ID", B2))),
        "saved_claim_staging_rule": (
            lambda f: saved("Claim staging vs curated (mapping rules)", B2)(f).failures,
            sql.reconcile("claim_master policy_master", {"CLAIM_ID": "text"}, {
                "POLICY_ID": "text", "CLAIM_DATE": "date", "CLAIM_STATUS": "text",
                "CLAIM_AMOUNT": "num", "APPROVED_AMOUNT": "num", "CLAIM_RATIO": "num"},
                src=f"{_CLAIM_SRC} WHERE BATCH_ID = '{B2}' AND POLICY_ID IN (SELECT POLICY_ID FROM stg_policy "
                    f"WHERE BATCH_ID = '{B2}' UNION SELECT POLICY_ID FROM policy_master)",
                tgt=_batch_scope("claim_master", "stg_claim", "CLAIM_ID", B2))),
        "saved_customer_staging_rule": (
            lambda f: saved("Customer staging vs curated (mapping rules)", B2)(f).failures,
            sql.reconcile("customer_360", {"CUSTOMER_ID": "text"},
                          {"CUSTOMER_NAME": "text", "EMAIL": "text"},
                          src=f"SELECT * FROM trn_customer WHERE BATCH_ID = '{B2}'",
                          tgt=_batch_scope("customer_360", "trn_customer", "CUSTOMER_ID", B2))),
        "staging_vs_curated_customer": (
            lambda f: restaged("customer")(f).failures,
            sql.reconcile("customer_360", {"CUSTOMER_ID": "text"},
                          {"CUSTOMER_NAME": "text", "EMAIL": "text"},
                          src="SELECT * FROM trn_customer",
                          tgt="SELECT * REPLACE (upper(EMAIL) AS EMAIL) FROM customer_360")),
        "orphan_claims": (
            lambda f: rule_failures(rules.orphan_claims(f.claim_master, f.policy_master), "x"),
            sql.violations("claim_master policy_master",
                           "claim_master c WHERE NOT EXISTS (SELECT 1 FROM policy_master p "
                           "WHERE p.POLICY_ID = c.POLICY_ID)", "CLAIM_ID", "POLICY_ID",
                           f"'{_ORPHANS[1]}'", "POLICY_ID", f"'{_ORPHANS[0]}'")),
        "orphan_claims_of_batch": (
            lambda f: saved("No orphan claims in curated", B3)(f).failures,
            sql.violations("claim_master policy_master",
                           "claim_master c WHERE CLAIM_ID IN (SELECT CLAIM_ID FROM trn_claim "
                           f"WHERE BATCH_ID = '{B3}') AND NOT EXISTS (SELECT 1 FROM policy_master "
                           "p WHERE p.POLICY_ID = c.POLICY_ID)", "CLAIM_ID", "POLICY_ID",
                           f"'{_ORPHANS[1]}'", "POLICY_ID", f"'{_ORPHANS[0]}'")),
        "claim_outside_coverage": (
            lambda f: rule_failures(rules.outside_coverage(f.claim_master, f.policy_master), "x"),
            sql.violations("claim_master policy_master",
                           "claim_master c JOIN policy_master p ON p.POLICY_ID = c.POLICY_ID "
                           "WHERE c.CLAIM_DATE < p.ISSUE_DATE OR c.CLAIM_DATE > p.EXPIRY_DATE",
                           "CLAIM_ID", "CLAIM_DATE", "CAST(p.ISSUE_DATE AS VARCHAR) || ' .. ' || "
                           "CAST(p.EXPIRY_DATE AS VARCHAR)", "CAST(c.CLAIM_DATE AS VARCHAR)",
                           "'Claim date falls outside the policy coverage window'")),
        "upsert_scd1": (scd1, sql.using("trn_policy", (
            f"SELECT * EXCLUDE (RECORD_EFFECTIVE_TS, BATCH_ID) REPLACE (CAST(CASE WHEN BATCH_ID <> "
            f"'{B1}' THEN PREMIUM_AMOUNT + 5 ELSE PREMIUM_AMOUNT END AS DECIMAL(12,2)) AS "
            f"PREMIUM_AMOUNT), RECORD_EFFECTIVE_TS AS LAST_UPDATED_TS FROM src"),
            src=_POLICY_SRC)),
        "batch_replace": (reload_batch, sql.using("trn_policy", (
            "SELECT POLICY_ID, BATCH_ID, PREMIUM_AMOUNT FROM trn_policy "
            f"WHERE BATCH_ID <> '{B2}' OR day(ISSUE_DATE) <> 13"))),
        "update_from": (corrected, sql.using("policy_master", (
            "SELECT m.* REPLACE (coalesce(t.PREMIUM_AMOUNT, m.PREMIUM_AMOUNT) AS PREMIUM_AMOUNT, "
            "coalesce(t.RECORD_EFFECTIVE_TS, m.LAST_UPDATED_TS) AS LAST_UPDATED_TS) "
            "FROM policy_master m LEFT JOIN trn_policy t ON t.POLICY_ID = m.POLICY_ID "
            f"AND t.BATCH_ID = '{B1}'"))),
        "keyed_update": (injected, sql.using("trn_claim", (
            "SELECT CLAIM_ID, CASE WHEN day(CLAIM_DATE) = 17 THEN 'P9999999' ELSE POLICY_ID END "
            "AS POLICY_ID, CASE WHEN day(CLAIM_DATE) = 23 THEN 'Pending' ELSE CLAIM_STATUS_DESC "
            "END AS CLAIM_STATUS FROM trn_claim"))),
        "watermark_transition": (
            lambda f: marks_after(f, B1, B2, B3),
            sql.using("trn_customer trn_policy trn_claim", _marks_sql(B1, B2, B3))),
        "watermark_out_of_order": (
            lambda f: marks_after(f, B1, B3, B2),
            sql.using("trn_customer trn_policy trn_claim", _marks_sql(B1, B3, B2))),
        "watermark_reload": (
            lambda f: marks_after(f, B1, B2, B2),
            sql.using("trn_customer trn_policy trn_claim", _marks_sql(B1, B2))),
        "watermark_boundary_policy": (boundary("STG_POLICY", later, B2),
                                      _boundary_sql("STG_POLICY", later, B2)),
        "watermark_boundary_claim": (boundary("STG_CLAIM", later, B2),
                                     _boundary_sql("STG_CLAIM", later, B2)),
        "watermark_boundary_customer": (boundary("STG_CUSTOMER", (B1,), B2),
                                        _boundary_sql("STG_CUSTOMER", (B1,), B2)),
        "watermark_moved_on": (boundary("STG_POLICY", BATCHES, B2),
                               _boundary_sql("STG_POLICY", BATCHES, B2)),
        "watermark_report": (
            lambda f: saved("Watermark status report", B2,
                            DQ_WATERMARK=lambda f: marks_after(f, B1, B2))(f).frame,
            sql.using("trn_customer trn_policy trn_claim", _marks_sql(B1, B2))),
        "latest_version": (
            lambda f: latest_claims(f).select(*version_cols),
            sql.using("claim_versions", f"SELECT {', '.join(version_cols)} FROM newest",
                      history=history, newest=newest)),
        "historical_claims": (
            lambda f: historical_claims(f).failures,
            sql.reconcile("claim_versions", {"CLAIM_ID": "text"}, {
                k: v for k, v in _CLAIM_COLS.items() if k != "CLAIM_RATIO"},
                history=history, newest=newest, loaded=loaded,
                src="SELECT *, CLAIM_STATUS_DESC AS CLAIM_STATUS FROM newest WHERE "
                    + _IN_DAYS.format(c="RECORD_EFFECTIVE_TS"),
                tgt="SELECT *, CASE WHEN day(CLAIM_DATE) = 23 THEN 'Pending' ELSE "
                    "CLAIM_STATUS_DESC END AS CLAIM_STATUS FROM loaded WHERE "
                    + _IN_DAYS.format(c="RECORD_EFFECTIVE_TS"))),
        "historical_policies": (
            lambda f: historical_policies(f).failures,
            sql.reconcile("policy_master", stale, {
                "CUSTOMER_ID": "text", "POLICY_TYPE": "text", "POLICY_STATUS": "text",
                "PREMIUM_AMOUNT": "num"},
                src=f"{_POLICY_SRC} WHERE " + _IN_DAYS.format(c="RECORD_EFFECTIVE_TS"),
                tgt="SELECT * FROM policy_master WHERE " + _IN_DAYS.format(c="LAST_UPDATED_TS"))),
        "historical_customers": (
            lambda f: historical_customers(f).failures,
            sql.reconcile("customer_360", {"CUSTOMER_ID": "text"},
                          {"CUSTOMER_NAME": "text", "EMAIL": "text"},
                          src="SELECT * FROM trn_customer WHERE RECORD_EFFECTIVE_TS < "
                              "TIMESTAMP '1995-06-02'",
                          tgt="SELECT * REPLACE (CASE WHEN CUSTOMER_NAME = 'UNKNOWN' THEN NULL "
                              "ELSE EMAIL END AS EMAIL) FROM customer_360 WHERE LAST_UPDATED_TS < "
                              "TIMESTAMP '1995-06-02'")),
        "validation_window": (batch_window, sql.using(
            "trn_customer trn_policy trn_claim",
            "SELECT CAST(min(ts) AS DATE) AS history_start, CAST(max(ts) AS DATE) AS history_end "
            "FROM (" + " UNION ALL ".join(
                f"SELECT RECORD_EFFECTIVE_TS AS ts FROM {t} WHERE BATCH_ID = '{B1}'"
                for t in ("trn_customer", "trn_policy", "trn_claim")) + ")")),
        "record_counts": (lambda f: record_counts(f.tables(), B2),
                          sql.using(_LAYERS, _counts_sql(B2))),
        "record_counts_by_layer": (
            lambda f: counts_by_layer(record_counts(f.tables(), B2)),
            sql.using(_LAYERS, "SELECT coalesce(layer, '(all)') AS layer, coalesce(table_name, "
                      "'(all)') AS table_name, CAST(sum(total_rows) AS BIGINT) AS total_rows, "
                      "CAST(sum(batch_rows) AS BIGINT) AS batch_rows FROM counts "
                      "GROUP BY ROLLUP (layer, table_name)", counts=_counts_sql(B2))),
        "regression_copies": (regression_copies, _copies_sql()),
    }


def _copies_sql() -> str:
    scope = f"CLAIM_ID IN (SELECT CLAIM_ID FROM trn_claim WHERE BATCH_ID = '{B2}')"
    parts = {
        "Policy transformation vs curated": sql.reconcile(
            "policy_master", {"POLICY_ID": "text"}, _POLICY_COLS,
            src=f"{_POLICY_SRC} WHERE BATCH_ID = '{B2}'",
            tgt=_batch_scope("policy_master", "trn_policy", "POLICY_ID", B2)),
        "Claim transformation vs curated": sql.reconcile(
            "claim_master", {"CLAIM_ID": "text"}, _CLAIM_COLS,
            src=f"{_CLAIM_SRC} WHERE BATCH_ID = '{B2}'",
            tgt=_batch_scope("claim_master", "trn_claim", "CLAIM_ID", B2)),
        "No orphan claims in curated": sql.using(
            "claim_master policy_master",
            f"SELECT 'RULE_VIOLATION' AS failure_type FROM claim_master c WHERE {scope} AND NOT "
            "EXISTS (SELECT 1 FROM policy_master p WHERE p.POLICY_ID = c.POLICY_ID)"),
        "Claim date inside policy coverage": sql.using(
            "claim_master policy_master",
            "SELECT 'RULE_VIOLATION' AS failure_type FROM claim_master c JOIN policy_master p "
            f"ON p.POLICY_ID = c.POLICY_ID WHERE {scope} AND (c.CLAIM_DATE < p.ISSUE_DATE OR "
            "c.CLAIM_DATE > p.EXPIRY_DATE)"),
    }
    return " UNION ALL ".join(
        f"SELECT failure_type, '{name}' AS test_name, count(*) AS failures FROM ({text}) "
        "GROUP BY failure_type" for name, text in parts.items())

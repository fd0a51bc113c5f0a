"""Pre-load checks, cleaning and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.preload import LoadCheck, clean_for_load, guess_table, spec_for
from plumbline.operators.profile import SKETCH_ERROR, distinct_counts, find_keys, profile
from plumbline.workload import sql
from plumbline.workload.feed import BLANK, FOREIGN, LOST, TWICE, WRONG, Feed


def text_policies(feed: Feed) -> DataFrame:
    """All policies as an incoming text file has them, with some days badly exported."""
    day = F.dayofmonth("ISSUE_DATE")
    p = feed.stg_policy
    return p.select(
        F.substring("POLICY_ID", 2, 30).cast("bigint").alias("line"),
        F.when(day == BLANK, " \t").otherwise(F.col("POLICY_ID")).alias(" policy_id "),
        F.col("CUSTOMER_ID"),
        F.when(day == LOST, F.rpad("POLICY_NUMBER", 31, "9")).otherwise(F.col("POLICY_NUMBER"))
        .alias("Policy_Number"),
        F.col("POLICY_TYPE"), F.col("POLICY_STATUS"),
        F.when(day == WRONG, F.concat(F.col("PREMIUM_AMOUNT").cast("string"), F.lit("k")))
        .otherwise(F.concat(F.lit(" "), F.col("PREMIUM_AMOUNT").cast("string")))
        .alias("PREMIUM_AMOUNT"),
        F.col("SUM_INSURED").cast("string").alias("SUM_INSURED"),
        F.when(day == TWICE, F.date_format("ISSUE_DATE", "dd/MM/yyyy"))
        .otherwise(F.col("ISSUE_DATE").cast("string")).alias("ISSUE_DATE"),
        F.when(day == FOREIGN, F.concat(F.date_format("EXPIRY_DATE", "yyyy"), F.lit("-02-30")))
        .otherwise(F.col("EXPIRY_DATE").cast("string")).alias("EXPIRY_DATE"),
        F.when(day == LOST, "yesterday").when(day == TWICE, F.lit(""))
        .otherwise(F.date_format("LAST_UPDATED_TS", "yyyy-MM-dd'T'HH:mm"))
        .alias("LAST_UPDATED_TS"),
        F.lit("x").alias("NOTES"),
    )


def check(feed: Feed) -> LoadCheck:
    return LoadCheck(text_policies(feed), spec_for("STG_POLICY"), row_id="line")


_FINDINGS = [  # check, column, problem, rows it hits, value shown
    ("required", "POLICY_ID", "POLICY_ID is empty", "d = 5", None),
    ("length", "POLICY_NUMBER", "POLICY_NUMBER is longer than 30 characters", "d = 13", None),
    ("number", "PREMIUM_AMOUNT", "PREMIUM_AMOUNT is not a number", "d = 23",
     "CAST(PREMIUM_AMOUNT AS VARCHAR) || 'k'"),
    ("date", "ISSUE_DATE", "ISSUE_DATE is not a YYYY-MM-DD date", "d = 19",
     "strftime(ISSUE_DATE, '%d/%m/%Y')"),
    ("date", "EXPIRY_DATE", "EXPIRY_DATE is not a YYYY-MM-DD date", "d = 17",
     "strftime(EXPIRY_DATE, '%Y') || '-02-30'"),
    ("timestamp", "LAST_UPDATED_TS", "LAST_UPDATED_TS is not a YYYY-MM-DD HH:MM:SS timestamp",
     "d = 13", "'yesterday'"),
]
_CLEAN_CHECKS = [
    ("required", "CUSTOMER_ID", "CUSTOMER_ID is empty"),
    ("length", "POLICY_ID", "POLICY_ID is longer than 20 characters"),
    ("length", "CUSTOMER_ID", "CUSTOMER_ID is longer than 20 characters"),
    ("length", "POLICY_TYPE", "POLICY_TYPE is longer than 20 characters"),
    ("length", "POLICY_STATUS", "POLICY_STATUS is longer than 20 characters"),
    ("number", "SUM_INSURED", "SUM_INSURED is not a number"),
    ("rows", "", "The file has no rows."),
]
_P = ("SELECT *, day(ISSUE_DATE) AS d, CAST(substr(POLICY_ID, 2) AS BIGINT) AS line "
      "FROM stg_policy")


def _counts_sql() -> str:
    parts = [f"SELECT '{c}' AS \"check\", '{n}' AS column_name, '{p}' AS problem, "
             f"count(*) FILTER (WHERE {w}) AS n_rows FROM p" for c, n, p, w, _ in _FINDINGS]
    parts += [f"SELECT '{c}', '{n}', '{p}', CAST(0 AS BIGINT)" for c, n, p in _CLEAN_CHECKS]
    return sql.using("stg_policy", " UNION ALL ".join(parts), p=_P)


def _violations_sql() -> str:
    return sql.using("stg_policy", " UNION ALL ".join(
        f"SELECT '{c}' AS \"check\", '{n}' AS column_name, line AS row, "
        f"{v or 'CAST(NULL AS VARCHAR)'} AS value FROM p WHERE {w}"
        for c, n, _, w, v in _FINDINGS), p=_P)


def _report_sql() -> str:
    parts = []
    for c, n, problem, w, v in _FINDINGS:
        show = "'row ' || line" + (f" || ' (''' || {v} || ''')'" if v else "")
        parts.append(
            f"SELECT 'blocking' AS severity, '{c}' AS \"check\", '{n}' AS column_name, n AS "
            f"n_rows, '{problem} in ' || n || ' row(s): ' || x || CASE WHEN n > 5 THEN ' …' ELSE "
            f"'' END AS message FROM (SELECT any_value(n) AS n, string_agg({show}, ', ' ORDER BY "
            f"line) AS x FROM (SELECT *, count(*) OVER () AS n FROM p WHERE {w} "
            "QUALIFY row_number() OVER (ORDER BY line) <= 5)) WHERE n > 0")
    parts.append(
        "SELECT 'warning', 'duplicate', 'POLICY_ID', CAST(1 AS BIGINT), '1 duplicate POLICY_ID "
        "value(s), e.g. ' FROM p WHERE d = 5 HAVING count(*) > 1")
    parts.append("SELECT 'warning', 'extra', 'NOTES', CAST(NULL AS BIGINT), "
                 "'Ignored column not in STG_POLICY: NOTES'")
    return sql.using("stg_policy", " UNION ALL ".join(parts), p=_P)


def cleaned(feed: Feed) -> DataFrame:
    """Good rows typed for staging; blanks become NULL and text keeps its padding."""
    good = text_policies(feed).filter(
        ~F.col("PREMIUM_AMOUNT").endswith("k")
        & ~F.col("LAST_UPDATED_TS").eqNullSafe("yesterday")
        & ~F.col("ISSUE_DATE").contains("/") & ~F.col("EXPIRY_DATE").endswith("-02-30")
    )
    return clean_for_load(good, spec_for("STG_POLICY"), "B9").drop("LOAD_TS")


# ---------------------------------------------------------------- profiles
# Expected profile of a column: kind, and its text form for counting and display.
_PROFILES = {
    "customer": [("c_custkey", "integer", "c"), ("c_name", "text", "c"),
                 ("c_nationkey", "integer", "c"), ("c_acctbal", "decimal", "d"),
                 ("c_mktsegment", "text", "c")],
    "orders": [("o_orderkey", "integer", "c"), ("o_custkey", "integer", "c"),
               ("o_orderstatus", "text", "c"), ("o_totalprice", "decimal", "d"),
               ("o_orderdate", "timestamp", "c"), ("o_orderpriority", "text", "c")],
    "lineitem": [("l_orderkey", "integer", "c"), ("l_partkey", "integer", "c"),
                 ("l_suppkey", "integer", "c"), ("l_linenumber", "integer", "c"),
                 ("l_quantity", "integer", "d"), ("l_extendedprice", "decimal", "d"),
                 ("l_discount", "decimal", "d"), ("l_tax", "decimal", "d"),
                 ("l_returnflag", "text", "c"), ("l_linestatus", "text", "c"),
                 ("l_shipdate", "timestamp", "c")],
    "part": [("p_partkey", "integer", "c"), ("p_name", "text", "c"), ("p_brand", "text", "c"),
             ("p_type", "text", "c"), ("p_size", "integer", "c"),
             ("p_retailprice", "decimal", "d")],
    "supplier": [("s_suppkey", "integer", "c"), ("s_name", "text", "c"),
                 ("s_nationkey", "integer", "c"), ("s_acctbal", "decimal", "d")],
    "documents": [("doc_id", "integer", "c"), ("text", "text", "c"), ("lang", "text", "c"),
                  ("source", "text", "c"), ("n_chars", "integer", "c")],
    "labels": [("doc_id", "integer", "c"), ("quality", "integer", "c"),
               ("toxic", "integer", "c")],
    "conversations": [("conv_id", "integer", "c"), ("turn", "integer", "c"),
                      ("role", "text", "c"), ("text", "text", "c")],
}


def _profile_sql(table: str) -> str:
    parts = []
    for i, (c, kind, form) in enumerate(_PROFILES[table]):
        def shown(agg, c=c, form=form):
            v = f"{agg}({c})"
            v = sql.plain(f"CAST({v} AS DECIMAL(18,4))") if form == "d" else f"CAST({v} AS VARCHAR)"
            return f"coalesce(substr({v}, 1, 60), '')"

        low, high = ("''", "''") if kind == "text" else (shown("min"), shown("max"))
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, '{kind}' AS kind, count(*) AS "
            f"row_count, count(*) - count({c}) AS null_count, CAST(((count(*) - count({c})) * 2000 "
            f"+ count(*)) // (count(*) * 2) AS DOUBLE) / 10 AS null_pct, count(DISTINCT {c}) AS "
            f"distinct_count, (count(*) > 0 AND count(DISTINCT {c}) = count(*)) AS is_key, "
            f"{low} AS min_value, {high} AS max_value, {shown('min')} AS example FROM {table}")
    return " UNION ALL ".join(parts)


def _profiled(table: str):
    return lambda f: profile(f.table(table))


def padded_customers(feed: Feed) -> DataFrame:
    """Customers with an all-empty column, dates as text, and NULLs in the balance."""
    return feed.table("customer").select(
        "c_custkey", F.lit(None).cast("string").alias("fax"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_nationkey")).cast("string")
        .alias("since"), (F.col("c_acctbal") > 0).alias("positive"))


def queries() -> dict:
    keys = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name FROM {t} "
        f"HAVING count(*) > 0 AND count(DISTINCT {c}) = count(*)"
        for t in ("customer", "orders", "part") for c, _, _ in _PROFILES[t])

    def all_keys(f: Feed) -> DataFrame:
        found = [(t, c) for t in ("customer", "orders", "part") for c in find_keys(f.table(t))[1]]
        return f.spark.createDataFrame(found, "table_name string, column_name string")

    def summary(f: Feed) -> DataFrame:
        facts, names = find_keys(f.table("orders"))
        return f.spark.createDataFrame(
            [(*facts.values(), len(names))],
            "row_count bigint, column_count bigint, columns_with_nulls bigint, candidate_keys bigint")

    def sketched(f: Feed) -> DataFrame:
        """Every column's sketched distinct count lies within five deviations of the exact one."""
        exact = distinct_counts(f.table("lineitem")).select("position", F.col("distinct_count").alias("exact_count"))
        found = profile(f.table("lineitem"), approximate=True).join(exact, "position")
        close = F.abs(F.col("distinct_count") - F.col("exact_count")) <= 5 * SKETCH_ERROR * F.col("exact_count")
        return found.select("position", "column_name", "kind", "row_count", "null_count", "exact_count", close.alias("close"))

    out = {
        "preload_counts": (lambda f: check(f).counts, _counts_sql()),
        "preload_violations": (lambda f: check(f).violations, _violations_sql()),
        "preload_report": (lambda f: check(f).report, _report_sql()),
        "preload_duplicates": (
            lambda f: LoadCheck(f.claim_versions, spec_for("STG_CLAIM")).duplicates,
            sql.using("claim_versions", "SELECT CLAIM_ID AS business_key, count(*) AS n_rows FROM "
                      "claim_versions GROUP BY CLAIM_ID HAVING count(*) > 1")),
        "load_cleaning": (cleaned, sql.using("stg_policy", (
            "SELECT CASE WHEN d <> 5 THEN POLICY_ID END AS POLICY_ID, CUSTOMER_ID, POLICY_NUMBER, "
            "POLICY_TYPE, POLICY_STATUS, PREMIUM_AMOUNT, SUM_INSURED, ISSUE_DATE, EXPIRY_DATE, "
            "LAST_UPDATED_TS, 'B9' AS BATCH_ID FROM p WHERE d NOT IN (13, 17, 19, 23)"), p=_P)),
        "guess_table": (
            lambda f: f.table("part").select(
                "p_partkey",
                guess_table(F.concat("p_name", F.when(F.col("p_size") < 10, "_policies.csv")
                                     .when(F.col("p_size") < 20, "Claims.txt")
                                     .when(F.col("p_size") < 30, " customer.csv")
                                     .otherwise(".csv"))).alias("table_name")),
            "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'STG_POLICY' WHEN p_size < 20 THEN "
            "'STG_CLAIM' WHEN p_size < 30 THEN 'STG_CUSTOMER' END AS table_name FROM part"),
        "candidate_keys": (all_keys, keys),
        "table_summary": (
            summary,
            "SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count, CAST(0 AS BIGINT) "
            "AS columns_with_nulls, CAST(" + " + ".join(
                f"CAST(count(DISTINCT {c}) = count(*) AS INT)" for c, _, _ in _PROFILES["orders"])
            + " AS BIGINT) AS candidate_keys FROM orders"),
        "profile_kinds": (
            lambda f: profile(padded_customers(f)).select(
                "column_name", "kind", "null_count", "null_pct", "distinct_count", "min_value"),
            "SELECT 'c_custkey' AS column_name, 'integer' AS kind, CAST(0 AS BIGINT) AS "
            "null_count, 0.0::DOUBLE AS null_pct, count(DISTINCT c_custkey) AS distinct_count, "
            "CAST(min(c_custkey) AS VARCHAR) AS min_value FROM customer UNION ALL "
            "SELECT 'fax', 'empty', count(*), 100.0, 0, '' FROM customer UNION ALL "
            "SELECT 'balance', 'decimal', count(*) FILTER (WHERE c_acctbal < 0), "
            "CAST((count(*) FILTER (WHERE c_acctbal < 0) * 2000 + count(*)) // (count(*) * 2) AS "
            "DOUBLE) / 10, count(DISTINCT c_acctbal) FILTER (WHERE c_acctbal >= 0), "
            + sql.plain("CAST(min(c_acctbal) FILTER (WHERE c_acctbal >= 0) AS DECIMAL(18,2))")
            + " FROM customer UNION ALL SELECT 'since', 'date', 0, 0.0, "
            "count(DISTINCT c_nationkey), CAST(DATE '2020-01-01' + min(c_nationkey) AS VARCHAR) "
            "FROM customer UNION ALL SELECT 'positive', 'boolean', 0, 0.0, "
            "count(DISTINCT c_acctbal > 0), CASE WHEN bool_and(c_acctbal > 0) THEN 'True' "
            "ELSE 'False' END FROM customer"),
        "profile_approximate": (
            sketched,
            " UNION ALL ".join(
                f"SELECT {i} AS position, '{c}' AS column_name, '{k}' AS kind, count(*) AS row_count, "
                f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS exact_count, true AS close FROM lineitem"
                for i, (c, k, _) in enumerate(_PROFILES["lineitem"]))),
    }
    for table in _PROFILES:
        out[f"profile_{table}"] = (_profiled(table), _profile_sql(table))
    return out

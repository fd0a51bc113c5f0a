"""DuckDB SQL for the same questions, over the same tables: the expected results."""

from __future__ import annotations

_BATCH = (
    "CASE WHEN year({c}) <= 1996 THEN 'BATCH_1996' WHEN year({c}) <= 1998 THEN 'BATCH_1998' "
    "ELSE 'BATCH_2001' END"
)
_M = "CAST({c} AS DECIMAL(12,2))".format


def plain(c: str) -> str:
    """Decimal text without trailing zeros."""
    return f"rtrim(rtrim(CAST({c} AS VARCHAR), '0'), '.')"


def ratio(approved: str, amount: str) -> str:
    """Half-up share to four places, in whole cents so that nothing is a double."""
    a, b = f"CAST({approved} * 100 AS HUGEINT)", f"CAST({amount} * 100 AS HUGEINT)"
    n = f"((2 * {a} * 10000 + {b}) // (2 * {b}))"
    return (
        f"CASE WHEN {approved} IS NULL OR {amount} IS NULL OR {amount} = 0 "
        f"THEN CAST(0 AS DECIMAL(10,4)) "
        f"ELSE CAST(CAST({n} AS DECIMAL(9,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(10,4)) END"
    )


def decode(c: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE upper(trim({c})) {whens} ELSE 'Unknown' END"


_TYPES = {"AUTO": "Automobile", "HOME": "Home Insurance", "HEALTH": "Health Insurance",
          "LIFE": "Life Insurance"}
_STATUS = {"A": "Active", "I": "Inactive", "C": "Cancelled", "L": "Lapsed"}
_CLAIM = {"P": "Pending", "A": "Approved", "R": "Rejected", "S": "Settled"}

_CLAIMS = f"""
        SELECT 'L' || {{id}} AS CLAIM_ID,
               'P' || l_orderkey AS POLICY_ID, 'S' || l_suppkey AS CUSTOMER_ID,
               CAST(l_shipdate AS DATE) AS CLAIM_DATE,
               {_M(c='l_extendedprice')} AS CLAIM_AMOUNT,
               CASE WHEN {_M(c='l_discount')} <> 0 THEN CAST({_M(c='l_extendedprice')}
                    * (1 - {_M(c='l_discount')} + {_M(c='l_tax')}) AS DECIMAL(12,2)) END
                    AS APPROVED_AMOUNT,
               CASE l_returnflag WHEN 'A' THEN 'a ' WHEN 'N' THEN ' p' WHEN 'R' THEN 'R'
                    ELSE 'X' END AS CLAIM_STATUS,
               l_linestatus AS INCIDENT_TYPE, l_shipdate AS LAST_UPDATED_TS,
               {_BATCH.format(c='l_shipdate')} AS BATCH_ID
        FROM lineitem"""

CTES = {
    "stg_customer": """
        SELECT 'C' || c_custkey AS CUSTOMER_ID,
               CASE WHEN c_acctbal < 0 THEN '  ' ELSE '  ' || c_name END AS CUSTOMER_NAME,
               upper(replace(c_name, '#', '.')) || '@Example.COM ' AS EMAIL,
               '+91' || (c_custkey + 7000000000) AS PHONE_NUMBER,
               ' new-' || lower(c_mktsegment) AS CITY,
               TIMESTAMP '1995-06-01 00:00:00' + to_seconds(c_custkey * 60) AS LAST_UPDATED_TS,
               'BATCH_1996' AS BATCH_ID
        FROM customer""",
    "stg_policy": f"""
        SELECT 'P' || o_orderkey AS POLICY_ID, 'C' || o_custkey AS CUSTOMER_ID,
               'PN-' || o_orderkey AS POLICY_NUMBER,
               CASE o_orderpriority WHEN '1-URGENT' THEN ' auto' WHEN '2-HIGH' THEN 'HOME'
                    WHEN '3-MEDIUM' THEN 'Health ' WHEN '4-NOT SPECIFIED' THEN 'LIFE'
                    WHEN '5-LOW' THEN 'MISC' ELSE '?' END AS POLICY_TYPE,
               CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'i' WHEN 'P' THEN 'C'
                    ELSE '?' END AS POLICY_STATUS,
               {_M(c='o_totalprice')} AS PREMIUM_AMOUNT,
               CAST({_M(c='o_totalprice')} * 10 AS DECIMAL(15,2)) AS SUM_INSURED,
               CAST(o_orderdate AS DATE) AS ISSUE_DATE,
               CAST(o_orderdate AS DATE) + 365 AS EXPIRY_DATE,
               o_orderdate AS LAST_UPDATED_TS, {_BATCH.format(c='o_orderdate')} AS BATCH_ID
        FROM orders""",
    "stg_claim": _CLAIMS.format(
        id="l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"),
    "claim_versions": _CLAIMS.format(id="l_orderkey || '-' || l_linenumber"),
    "trn_customer": """
        SELECT trim(CUSTOMER_ID) AS CUSTOMER_ID,
               coalesce(nullif(upper(trim(CUSTOMER_NAME)), ''), 'UNKNOWN') AS CUSTOMER_NAME,
               lower(trim(EMAIL)) AS EMAIL,
               array_to_string(list_transform(string_split(lower(trim(CITY)), '-'),
                   lambda w: upper(w[1]) || w[2:]), '-') AS LOCATION_DESC,
               BATCH_ID, LAST_UPDATED_TS AS RECORD_EFFECTIVE_TS
        FROM stg_customer""",
    "trn_policy": f"""
        SELECT trim(POLICY_ID) AS POLICY_ID, trim(CUSTOMER_ID) AS CUSTOMER_ID,
               {decode('POLICY_TYPE', _TYPES)} AS POLICY_TYPE_DESC,
               {decode('POLICY_STATUS', _STATUS)} AS POLICY_STATUS_DESC,
               PREMIUM_AMOUNT, CAST(EXPIRY_DATE - ISSUE_DATE AS INTEGER) AS POLICY_TERM_DAYS,
               ISSUE_DATE, EXPIRY_DATE, LAST_UPDATED_TS AS RECORD_EFFECTIVE_TS, BATCH_ID
        FROM stg_policy""",
    "trn_claim": f"""
        SELECT CLAIM_ID, POLICY_ID, {decode('CLAIM_STATUS', _CLAIM)} AS CLAIM_STATUS_DESC,
               {ratio('APPROVED_AMOUNT', 'CLAIM_AMOUNT')} AS CLAIM_RATIO,
               CAST(CLAIM_AMOUNT - coalesce(APPROVED_AMOUNT, 0) AS DECIMAL(12,2))
                   AS OUTSTANDING_AMOUNT,
               strftime(CLAIM_DATE, '%Y-%m') AS CLAIM_YEAR_MONTH, CLAIM_DATE, CLAIM_AMOUNT,
               CAST(coalesce(APPROVED_AMOUNT, 0) AS DECIMAL(12,2)) AS APPROVED_AMOUNT,
               LAST_UPDATED_TS AS RECORD_EFFECTIVE_TS, BATCH_ID
        FROM stg_claim""",
    "policy_master": """
        SELECT POLICY_ID, CUSTOMER_ID, POLICY_TYPE_DESC AS POLICY_TYPE,
               POLICY_STATUS_DESC AS POLICY_STATUS,
               CAST(CASE WHEN day(ISSUE_DATE) = 23 THEN PREMIUM_AMOUNT + 100
                    ELSE PREMIUM_AMOUNT END AS DECIMAL(12,2)) AS PREMIUM_AMOUNT,
               ISSUE_DATE, EXPIRY_DATE, RECORD_EFFECTIVE_TS AS LAST_UPDATED_TS
        FROM trn_policy WHERE day(ISSUE_DATE) <> 13""",
    "claim_master": """
        SELECT CLAIM_ID,
               CASE WHEN day(CLAIM_DATE) = 17 THEN 'X' || POLICY_ID ELSE POLICY_ID END
                   AS POLICY_ID,
               CLAIM_DATE, CLAIM_AMOUNT, APPROVED_AMOUNT,
               CASE WHEN day(CLAIM_DATE) = 23 THEN 'Pending' ELSE CLAIM_STATUS_DESC END
                   AS CLAIM_STATUS,
               CLAIM_RATIO, RECORD_EFFECTIVE_TS AS LAST_UPDATED_TS
        FROM trn_claim WHERE day(CLAIM_DATE) <> 13""",
    "pol_totals": """
        SELECT CUSTOMER_ID, sum(PREMIUM_AMOUNT) AS TOTAL_PREMIUM FROM policy_master
        GROUP BY CUSTOMER_ID""",
    "clm_totals": """
        SELECT p.CUSTOMER_ID, count(c.CLAIM_ID) AS TOTAL_CLAIMS,
               sum(c.CLAIM_AMOUNT) AS TOTAL_CLAIM_AMOUNT
        FROM policy_master p JOIN claim_master c ON c.POLICY_ID = p.POLICY_ID
        GROUP BY p.CUSTOMER_ID""",
    "true_360": """
        SELECT c.CUSTOMER_ID, c.CUSTOMER_NAME, c.EMAIL, c.RECORD_EFFECTIVE_TS AS LAST_UPDATED_TS,
               CAST(coalesce(p.TOTAL_PREMIUM, 0) AS DECIMAL(15,2)) AS TOTAL_PREMIUM,
               CAST(coalesce(k.TOTAL_CLAIMS, 0) AS BIGINT) AS TOTAL_CLAIMS,
               CAST(coalesce(k.TOTAL_CLAIM_AMOUNT, 0) AS DECIMAL(15,2)) AS TOTAL_CLAIM_AMOUNT
        FROM trn_customer c LEFT JOIN pol_totals p ON p.CUSTOMER_ID = c.CUSTOMER_ID
        LEFT JOIN clm_totals k ON k.CUSTOMER_ID = c.CUSTOMER_ID""",
    "customer_360": """
        SELECT * REPLACE (CAST(CASE WHEN CUSTOMER_NAME = 'UNKNOWN' THEN TOTAL_PREMIUM + 0.02
                          ELSE TOTAL_PREMIUM END AS DECIMAL(15,2)) AS TOTAL_PREMIUM)
        FROM true_360""",
    "run_log": """
        SELECT format('E{:012d}', event_id) AS execution_id,
               'RUN_' || strftime(ts, '%Y%m%d') AS run_id,
               format('TC-{:04d}', user_id) AS test_case_id, 'Check ' || user_id AS test_name,
               CASE WHEN user_id < 100 THEN 'PRJ-1' ELSE 'PRJ-2' END AS project_id,
               CASE WHEN user_id < 40 THEN '/Staging' WHEN user_id < 80 THEN '/Regression'
                    WHEN user_id < 120 THEN '/Regression/Nightly' ELSE '/Reg_Archive' END
                   AS folder_path,
               CAST(day(ts) AS INTEGER) AS test_version_no, ts AS run_ts,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'FAIL' ELSE 'PASS' END
                   AS status,
               CAST(CASE WHEN event_type IN ('error', 'view') THEN floor(value) ELSE 0 END
                   AS BIGINT) AS failed_record_count
        FROM events""",
    "latest_run": """
        SELECT * FROM run_log QUALIFY row_number() OVER (
            PARTITION BY test_case_id ORDER BY run_ts DESC, execution_id) = 1""",
    "failure_log": """
        SELECT format('F{:012d}', event_id) AS failure_id,
               format('E{:012d}', event_id) AS execution_id,
               format('TC-{:04d}', user_id) AS test_case_id, 'K' || user_id AS business_key,
               CASE WHEN event_type = 'error' THEN 'PREMIUM_AMOUNT'
                    WHEN hour(ts) < 12 THEN 'CLAIM_STATUS' END AS column_name,
               ts AS failed_ts
        FROM events WHERE event_type IN ('error', 'view')""",
    "catalog": """
        SELECT format('TC-{:04d}', p_partkey) AS test_case_id,
               CASE WHEN p_size = 7 THEN ' ' ELSE p_name END AS test_name,
               CASE p_type WHEN 'ECONOMY' THEN 'SOURCE_TARGET_COMPARE'
                    WHEN 'STANDARD' THEN 'ROW_COUNT_MATCH' WHEN 'SMALL' THEN 'SQL_ROWCOUNT'
                    WHEN 'LARGE' THEN 'STATUS_COLUMN' WHEN 'PROMO' THEN 'INFORMATIONAL'
                    ELSE 'OTHER' END AS test_type,
               p_brand AS folder_id, p_size, p_type, p_name,
               p_size <> 11 AS is_active, p_size AS version_no
        FROM part""",
}
_NEEDS = {
    "trn_customer": ["stg_customer"],
    "trn_policy": ["stg_policy"], "trn_claim": ["stg_claim"], "policy_master": ["trn_policy"],
    "claim_master": ["trn_claim"], "pol_totals": ["policy_master"],
    "clm_totals": ["policy_master", "claim_master"],
    "true_360": ["trn_customer", "pol_totals", "clm_totals"], "customer_360": ["true_360"],
    "latest_run": ["run_log"],
}


def using(names: str, body: str, **extra: str) -> str:
    """Body with the named CTEs (and what they need) and any extra ones in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


FAILURES = ("business_key", "column_name", "expected_value", "actual_value", "failure_type",
            "failure_reason")


def shown(kind: str, c: str) -> str:
    text = plain(c) if kind == "num" else f"CAST({c} AS VARCHAR)"
    return f"coalesce({text}, '<NULL>')"


def reconcile(
    names: str, keys: dict[str, str], columns: dict[str, str], metrics: bool = False,
    tolerance: str | None = None, same: dict[str, str] | None = None, **extra: str,
) -> str:
    """
    Failures (or metrics) of CTE ``src`` against CTE ``tgt``. ``keys`` and
    ``columns`` map names to num, text or date; ``same`` overrides the equality
    of a column as SQL over s.NAME and t.NAME.
    """
    klist, order = ", ".join(keys), ", ".join(f"{c} ASC NULLS FIRST" for c in columns)
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)
    equal = {}
    for c, kind in columns.items():
        equal[c] = f"s.{c} IS NOT DISTINCT FROM t.{c}"
        if tolerance and kind == "num":
            equal[c] = f"({equal[c]} OR coalesce(abs(s.{c} - t.{c}) <= {tolerance}, false))"
    equal.update(same or {})
    key = " || ' | ' || ".join(shown(kind, f"coalesce(s.{k}, t.{k})") for k, kind in keys.items())
    fields = [f"{key} AS k", "coalesce(s.n, 0) AS sn", "coalesce(t.n, 0) AS tn"]
    for c, kind in columns.items():
        fields += [f"{shown(kind, 's.' + c)} AS s_{c}", f"{shown(kind, 't.' + c)} AS t_{c}",
                   f"(s.n > 0 AND t.n > 0 AND NOT ({equal[c]})) AS d_{c}"]
    rank = (f"*, row_number() OVER (PARTITION BY {klist} ORDER BY {order or '1'}) AS rn, "
            f"count(*) OVER (PARTITION BY {klist}) AS n")
    ctes = {
        **extra,
        "s1": f"SELECT * FROM (SELECT {rank} FROM src) WHERE rn = 1",
        "t1": f"SELECT * FROM (SELECT {rank} FROM tgt) WHERE rn = 1",
        "j": f"SELECT {', '.join(fields)} FROM s1 s FULL JOIN t1 t ON {on}",
    }
    cols = ",".join(keys)
    any_diff = " OR ".join(f"coalesce(d_{c}, false)" for c in columns) or "false"
    if metrics:
        n_fail = " + ".join(
            ["CAST(sn > 1 AS INT)", "CAST(tn > 1 AS INT)", "CAST(sn = 0 AS INT)",
             "CAST(tn = 0 AS INT)", *[f"CAST(coalesce(d_{c}, false) AS INT)" for c in columns]])
        body = (f"SELECT CASE WHEN sum({n_fail}) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, "
                "CAST(sum(sn) AS BIGINT) AS source_row_count, "
                "CAST(sum(tn) AS BIGINT) AS target_row_count, CAST(count(*) FILTER "
                f"(WHERE sn > 0 AND tn > 0 AND NOT ({any_diff})) AS BIGINT) "
                f"AS matched_record_count, CAST(sum({n_fail}) AS BIGINT) AS failed_record_count, "
                f"sum({n_fail}) > 1000 AS truncated FROM j")
        return using(names, body, **ctes)
    parts = []
    for n, side in (("sn", "SOURCE"), ("tn", "TARGET")):
        parts.append((f"'{cols}'", "'1 row'", f"{n} || ' rows'", "DUPLICATE_KEY",
                      f"'Business key appears ' || {n} || ' times in the {side} result set'",
                      f"{n} > 1"))
    parts.append((f"'{cols}'", "'record present in target'", "'<NOT FOUND>'", "MISSING_IN_TARGET",
                  "'Record exists in source but was not loaded into target'", "tn = 0"))
    parts.append((f"'{cols}'", "'<NOT IN SOURCE>'", "'record present in target'",
                  "EXTRA_IN_TARGET",
                  "'Record exists in target but has no matching source record'", "sn = 0"))
    for c in columns:
        parts.append((f"'{c}'", f"s_{c}", f"t_{c}", "VALUE_MISMATCH",
                      f"'{c} does not match between source and target'", f"d_{c}"))
    body = " UNION ALL ".join(
        f"SELECT k AS business_key, {c} AS column_name, {e} AS expected_value, "
        f"{a} AS actual_value, '{t}' AS failure_type, {r} AS failure_reason FROM j WHERE {w}"
        for c, e, a, t, r, w in parts
    )
    return using(names, body, **ctes)


def violations(
    names: str, rows: str, key: str, column: str, expected: str, actual: str, reason: str,
    **extra: str,
) -> str:
    """Failure rows of a rule query: ``rows`` is a FROM clause with its WHERE."""
    body = (f"SELECT {key} AS business_key, '{column}' AS column_name, "
            f"coalesce({expected}, '<NULL>') AS expected_value, "
            f"coalesce({actual}, '<NULL>') AS actual_value, "
            f"'RULE_VIOLATION' AS failure_type, {reason} AS failure_reason FROM {rows}")
    return using(names, body, **extra)

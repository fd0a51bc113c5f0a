"""Declared schemas, as DDL: contract tables, control tables and the outputs of checks."""

from __future__ import annotations

import re


def columns(ddl: str) -> list[str]:
    """Column names of a DDL schema."""
    return [part.split()[0] for part in re.split(r",\s*(?![^(]*\))", ddl)]


def types(ddl: str) -> dict[str, str]:
    """Column name -> type of a DDL schema."""
    return dict(part.split(None, 1) for part in re.split(r",\s*(?![^(]*\))", ddl))


# What every check reports, one row per failure.
FAILURE = (
    "test_id string, business_key string, column_name string, expected_value string, "
    "actual_value string, failure_type string, failure_reason string"
)
FAILURE_COLUMNS = columns(FAILURE)[1:]

# What every check measures, one row per run of a check.
METRICS = (
    "test_id string, status string, source_row_count bigint, target_row_count bigint, "
    "matched_record_count bigint, failed_record_count bigint, truncated boolean, "
    "duration_ms bigint, error_message string"
)

# Most failures a report shows; the stored result is always complete.
DISPLAY_CAP = 1000

STG_CUSTOMER = (
    "CUSTOMER_ID string, CUSTOMER_NAME string, EMAIL string, PHONE_NUMBER string, CITY string, "
    "LAST_UPDATED_TS timestamp_ntz, BATCH_ID string, LOAD_TS timestamp_ntz"
)
STG_POLICY = (
    "POLICY_ID string, CUSTOMER_ID string, POLICY_NUMBER string, POLICY_TYPE string, "
    "POLICY_STATUS string, PREMIUM_AMOUNT decimal(12,2), SUM_INSURED decimal(15,2), "
    "ISSUE_DATE date, EXPIRY_DATE date, LAST_UPDATED_TS timestamp_ntz, BATCH_ID string, "
    "LOAD_TS timestamp_ntz"
)
STG_CLAIM = (
    "CLAIM_ID string, POLICY_ID string, CUSTOMER_ID string, CLAIM_DATE date, "
    "CLAIM_AMOUNT decimal(12,2), APPROVED_AMOUNT decimal(12,2), CLAIM_STATUS string, "
    "INCIDENT_TYPE string, LAST_UPDATED_TS timestamp_ntz, BATCH_ID string, LOAD_TS timestamp_ntz"
)
TRN_CUSTOMER = (
    "CUSTOMER_ID string, CUSTOMER_NAME string, EMAIL string, LOCATION_DESC string, "
    "BATCH_ID string, RECORD_EFFECTIVE_TS timestamp_ntz"
)
TRN_POLICY = (
    "POLICY_ID string, CUSTOMER_ID string, POLICY_TYPE_DESC string, POLICY_STATUS_DESC string, "
    "PREMIUM_AMOUNT decimal(12,2), POLICY_TERM_DAYS int, ISSUE_DATE date, EXPIRY_DATE date, "
    "RECORD_EFFECTIVE_TS timestamp_ntz, BATCH_ID string"
)
TRN_CLAIM = (
    "CLAIM_ID string, POLICY_ID string, CLAIM_STATUS_DESC string, CLAIM_RATIO decimal(10,4), "
    "OUTSTANDING_AMOUNT decimal(12,2), CLAIM_YEAR_MONTH string, CLAIM_DATE date, "
    "CLAIM_AMOUNT decimal(12,2), APPROVED_AMOUNT decimal(12,2), "
    "RECORD_EFFECTIVE_TS timestamp_ntz, BATCH_ID string"
)
CUSTOMER_360 = (
    "CUSTOMER_ID string, CUSTOMER_NAME string, EMAIL string, TOTAL_PREMIUM decimal(15,2), "
    "TOTAL_CLAIMS bigint, TOTAL_CLAIM_AMOUNT decimal(15,2), LAST_UPDATED_TS timestamp_ntz"
)
POLICY_MASTER = (
    "POLICY_ID string, CUSTOMER_ID string, POLICY_TYPE string, POLICY_STATUS string, "
    "PREMIUM_AMOUNT decimal(12,2), ISSUE_DATE date, EXPIRY_DATE date, "
    "LAST_UPDATED_TS timestamp_ntz"
)
CLAIM_MASTER = (
    "CLAIM_ID string, POLICY_ID string, CLAIM_DATE date, CLAIM_AMOUNT decimal(12,2), "
    "APPROVED_AMOUNT decimal(12,2), CLAIM_STATUS string, CLAIM_RATIO decimal(10,4), "
    "LAST_UPDATED_TS timestamp_ntz"
)
DQ_WATERMARK = (
    "PROCESS_NAME string, PREVIOUS_WATERMARK timestamp_ntz, BATCH_HIGH_WATERMARK timestamp_ntz, "
    "LAST_BATCH_ID string, ROWS_PROCESSED bigint, LOAD_STATUS string, VALIDATION_STATUS string, "
    "UPDATED_TS timestamp_ntz"
)
DQ_BATCH_METADATA = (
    "BATCH_ID string, SOURCE_SYSTEM string, SOURCE_FILE string, SOURCE_ROWS bigint, "
    "LOADED_ROWS bigint, REJECT_ROWS bigint, LOAD_STATUS string, LOAD_TS timestamp_ntz"
)
EXECUTION_LOG = (
    "execution_id string, run_id string, test_case_id string, test_name string, "
    "project_id string, folder_path string, test_version_no int, batch_id string, "
    "run_ts timestamp_ntz, status string, source_row_count bigint, target_row_count bigint, "
    "matched_record_count bigint, failed_record_count bigint, duration_ms bigint, "
    "run_mode string, params_json string, error_message string, executed_by string"
)
FAILURE_LOG = (
    "failure_id string, execution_id string, test_case_id string, batch_id string, "
    "business_key string, column_name string, expected_value string, actual_value string, "
    "failure_type string, failure_reason string, failed_ts timestamp_ntz"
)
REGRESSION_RUN = (
    "regression_id string, run_id string, project_id string, folder_path string, "
    "triggered_from string, selected_test_ids array<string>, history_start timestamp_ntz, "
    "history_end timestamp_ntz, total_tests bigint, passed_tests bigint, failed_tests bigint, "
    "error_tests bigint, started_ts timestamp_ntz, completed_ts timestamp_ntz, "
    "executed_by string"
)

TABLES = {
    name: globals()[name]
    for name in (
        "STG_CUSTOMER", "STG_POLICY", "STG_CLAIM",
        "TRN_CUSTOMER", "TRN_POLICY", "TRN_CLAIM",
        "CUSTOMER_360", "POLICY_MASTER", "CLAIM_MASTER",
        "DQ_WATERMARK", "DQ_BATCH_METADATA",
    )
}

# Staging table -> (business key, transformation table, curated table, watermark process).
ENTITIES = {
    "STG_CUSTOMER": ("CUSTOMER_ID", "TRN_CUSTOMER", "CUSTOMER_360", "CUSTOMER_CURATED_LOAD"),
    "STG_POLICY": ("POLICY_ID", "TRN_POLICY", "POLICY_MASTER", "POLICY_CURATED_LOAD"),
    "STG_CLAIM": ("CLAIM_ID", "TRN_CLAIM", "CLAIM_MASTER", "CLAIM_CURATED_LOAD"),
}

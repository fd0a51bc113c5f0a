"""
Mapping rules from staging to transformation, one projection per entity.

Rule numbers in the comments: CUS customer, POL policy, CLM claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions.text import decode, title_or_unknown, upper_or_unknown
from plumbline.operators.linkage import linked

# Code tables.
POLICY_TYPES = {
    "AUTO": "Automobile",
    "HOME": "Home Insurance",
    "HEALTH": "Health Insurance",
    "LIFE": "Life Insurance",
}
POLICY_STATUSES = {"A": "Active", "I": "Inactive", "C": "Cancelled", "L": "Lapsed"}
CLAIM_STATUSES = {"P": "Pending", "A": "Approved", "R": "Rejected", "S": "Settled"}


def claim_ratio(approved: Column, amount: Column) -> Column:
    """Approved share of the claimed amount to 4 places; 0 when there is nothing to divide."""
    share = approved / F.nullif(amount, F.lit(0).cast("decimal(12,2)"))
    return F.round(F.coalesce(share, F.lit(0)), 4).cast("decimal(10,4)")


def term_days(issue: Column, expiry: Column) -> Column:
    return F.date_diff(expiry.cast("date"), issue.cast("date"))


def map_customer(stg: DataFrame) -> DataFrame:
    return stg.filter(F.col("CUSTOMER_ID").isNotNull()).select(
        F.trim("CUSTOMER_ID").alias("CUSTOMER_ID"),                         # CUS-001
        upper_or_unknown(F.col("CUSTOMER_NAME")).alias("CUSTOMER_NAME"),    # CUS-002
        F.lower(F.trim("EMAIL")).alias("EMAIL"),                            # CUS-003
        title_or_unknown(F.col("CITY")).alias("LOCATION_DESC"),             # CUS-004
        "BATCH_ID",
        F.col("LAST_UPDATED_TS").alias("RECORD_EFFECTIVE_TS"),
    )


def map_policy(stg: DataFrame) -> DataFrame:
    return stg.filter(F.col("POLICY_ID").isNotNull()).select(
        F.trim("POLICY_ID").alias("POLICY_ID"),
        F.trim("CUSTOMER_ID").alias("CUSTOMER_ID"),
        decode(F.col("POLICY_TYPE"), POLICY_TYPES).alias("POLICY_TYPE_DESC"),          # POL-001
        decode(F.col("POLICY_STATUS"), POLICY_STATUSES).alias("POLICY_STATUS_DESC"),   # POL-002
        F.round("PREMIUM_AMOUNT", 2).cast("decimal(12,2)").alias("PREMIUM_AMOUNT"),    # POL-003
        term_days(F.col("ISSUE_DATE"), F.col("EXPIRY_DATE")).alias("POLICY_TERM_DAYS"),  # POL-004
        "ISSUE_DATE",                                                                  # POL-005
        "EXPIRY_DATE",
        F.col("LAST_UPDATED_TS").alias("RECORD_EFFECTIVE_TS"),                         # POL-006
        "BATCH_ID",
    )


def map_claim(stg: DataFrame, *policies: DataFrame) -> DataFrame:
    """
    Claims of a batch. ``policies`` are the tables a claim may point at (CLM-006);
    ids are matched as staged, without trimming.
    """
    claims = stg.filter(F.col("CLAIM_ID").isNotNull())
    if policies:
        claims = linked(claims, "POLICY_ID", *policies)
    approved = F.coalesce("APPROVED_AMOUNT", F.lit(0).cast("decimal(12,2)"))
    types = schemas.types(schemas.TRN_CLAIM)
    return claims.select(
        "CLAIM_ID",
        "POLICY_ID",
        decode(F.col("CLAIM_STATUS"), CLAIM_STATUSES).alias("CLAIM_STATUS_DESC"),      # CLM-001
        claim_ratio(F.col("APPROVED_AMOUNT"), F.col("CLAIM_AMOUNT")).alias("CLAIM_RATIO"),  # -002
        (F.col("CLAIM_AMOUNT") - approved)
        .cast(types["OUTSTANDING_AMOUNT"]).alias("OUTSTANDING_AMOUNT"),                # CLM-003
        F.date_format("CLAIM_DATE", "yyyy-MM").alias("CLAIM_YEAR_MONTH"),              # CLM-004
        "CLAIM_DATE",                                                                  # CLM-005
        "CLAIM_AMOUNT",
        approved.cast(types["APPROVED_AMOUNT"]).alias("APPROVED_AMOUNT"),
        F.col("LAST_UPDATED_TS").alias("RECORD_EFFECTIVE_TS"),
        "BATCH_ID",
    )


# Transformation rows as their curated tables name them.
def policy_rows(trn: DataFrame) -> DataFrame:
    return trn.select(
        "POLICY_ID", "CUSTOMER_ID", F.col("POLICY_TYPE_DESC").alias("POLICY_TYPE"),
        F.col("POLICY_STATUS_DESC").alias("POLICY_STATUS"), "PREMIUM_AMOUNT", "ISSUE_DATE",
        "EXPIRY_DATE", F.col("RECORD_EFFECTIVE_TS").alias("LAST_UPDATED_TS"),
    )


def claim_rows(trn: DataFrame) -> DataFrame:
    return trn.select(
        "CLAIM_ID", "POLICY_ID", "CLAIM_DATE", "CLAIM_AMOUNT", "APPROVED_AMOUNT",
        F.col("CLAIM_STATUS_DESC").alias("CLAIM_STATUS"), "CLAIM_RATIO",
        F.col("RECORD_EFFECTIVE_TS").alias("LAST_UPDATED_TS"),
    )


def customer_rows(trn: DataFrame) -> DataFrame:
    return trn.select(
        "CUSTOMER_ID", "CUSTOMER_NAME", "EMAIL",
        F.col("RECORD_EFFECTIVE_TS").alias("LAST_UPDATED_TS"),
    )

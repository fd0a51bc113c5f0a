"""
The insurance tables, derived from the given TPC-H-like tables over all their rows.

customer -> customers, orders -> policies, lineitem -> claims, events -> run log,
part -> saved checks. Every frame covers its whole input. Where a query needs
something to find, the *target* side is altered for business reasons that select
by day of the month: a day whose load was lost, was loaded twice, arrived under
foreign keys, or carries a wrong value.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.mutate import customer_totals, with_totals
from plumbline.plans import mapping

BATCHES = ("BATCH_1996", "BATCH_1998", "BATCH_2001")
LAST_YEARS = (1996, 1998)  # the third batch takes the rest

# Days of the month on which something went wrong on the target side.
LOST, TWICE, FOREIGN, WRONG, BLANK = 13, 19, 17, 23, 5
KEY_SHIFT = 1_000_000_000  # foreign keys are moved out of the real range

# Sizes of the ids made here: a letter and 64-bit keys of 20 characters; a claim's has three of them and a 32-bit number.
ID_WIDTHS = {"CUSTOMER_ID": 21, "POLICY_ID": 21, "CLAIM_ID": 1 + 3 * 20 + 11 + 3, "PHONE_NUMBER": 23}

POLICY_CODES = {"1-URGENT": " auto", "2-HIGH": "HOME", "3-MEDIUM": "Health ",
                "4-NOT SPECIFIED": "LIFE", "5-LOW": "MISC"}
STATUS_CODES = {"F": "A", "O": "i", "P": "C"}
CLAIM_CODES = {"A": "a ", "N": " p", "R": "R"}
RUN_STATUS = {"error": "ERROR", "view": "FAIL"}


def code(c: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def batch_of_year(ts: Column) -> Column:
    year = F.year(ts)
    return (
        F.when(year <= LAST_YEARS[0], BATCHES[0]).when(year <= LAST_YEARS[1], BATCHES[1])
        .otherwise(BATCHES[2])
    )


def money(c: Column) -> Column:
    return c.cast("decimal(12,2)")


class Feed:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------ staging
    @cached_property
    def stg_customer(self) -> DataFrame:
        return self.table("customer").select(
            F.concat(F.lit("C"), "c_custkey").alias("CUSTOMER_ID"),
            F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.concat(F.lit("  "), "c_name"))
            .alias("CUSTOMER_NAME"),
            F.concat(F.upper(F.translate("c_name", "#", ".")), F.lit("@Example.COM "))
            .alias("EMAIL"),
            F.concat(F.lit("+91"), F.col("c_custkey") + 7000000000).alias("PHONE_NUMBER"),
            F.concat(F.lit(" new-"), F.lower("c_mktsegment")).alias("CITY"),
            F.expr("timestamp_ntz'1995-06-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE")
            .alias("LAST_UPDATED_TS"),
            F.lit(BATCHES[0]).alias("BATCH_ID"),
        )

    @cached_property
    def stg_policy(self) -> DataFrame:
        issued = F.col("o_orderdate").cast("date")
        return self.table("orders").select(
            F.concat(F.lit("P"), "o_orderkey").alias("POLICY_ID"),
            F.concat(F.lit("C"), "o_custkey").alias("CUSTOMER_ID"),
            F.concat(F.lit("PN-"), "o_orderkey").alias("POLICY_NUMBER"),
            code(F.col("o_orderpriority"), POLICY_CODES, "?").alias("POLICY_TYPE"),
            code(F.col("o_orderstatus"), STATUS_CODES, "?").alias("POLICY_STATUS"),
            money(F.col("o_totalprice")).alias("PREMIUM_AMOUNT"),
            (money(F.col("o_totalprice")) * 10).cast("decimal(15,2)").alias("SUM_INSURED"),
            issued.alias("ISSUE_DATE"),
            F.date_add(issued, 365).alias("EXPIRY_DATE"),
            F.col("o_orderdate").alias("LAST_UPDATED_TS"),
            batch_of_year(F.col("o_orderdate")).alias("BATCH_ID"),
        )

    def _claims(self, *id_parts: str) -> DataFrame:
        amount, off, tax = (money(F.col(c)) for c in ("l_extendedprice", "l_discount", "l_tax"))
        return self.table("lineitem").select(
            F.concat(F.lit("L"), F.concat_ws("-", *[F.col(c).cast("string") for c in id_parts]))
            .alias("CLAIM_ID"),
            F.concat(F.lit("P"), "l_orderkey").alias("POLICY_ID"),
            F.concat(F.lit("S"), "l_suppkey").alias("CUSTOMER_ID"),
            F.col("l_shipdate").cast("date").alias("CLAIM_DATE"),
            amount.alias("CLAIM_AMOUNT"),
            F.when(off != 0, (amount * (1 - off + tax)).cast("decimal(12,2)"))
            .alias("APPROVED_AMOUNT"),
            code(F.col("l_returnflag"), CLAIM_CODES, "X").alias("CLAIM_STATUS"),
            F.col("l_linestatus").alias("INCIDENT_TYPE"),
            F.col("l_shipdate").alias("LAST_UPDATED_TS"),
            batch_of_year(F.col("l_shipdate")).alias("BATCH_ID"),
        )

    @cached_property
    def stg_claim(self) -> DataFrame:
        """Every line item as a claim of its own."""
        return self._claims("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    @cached_property
    def claim_versions(self) -> DataFrame:
        """Every line item as a delivered version of a claim; ids repeat within and over batches."""
        return self._claims("l_orderkey", "l_linenumber")

    # ------------------------------------------------------------ transformation
    @cached_property
    def trn_customer(self) -> DataFrame:
        return mapping.map_customer(self.stg_customer)

    @cached_property
    def trn_policy(self) -> DataFrame:
        return mapping.map_policy(self.stg_policy)

    @cached_property
    def trn_claim(self) -> DataFrame:
        return mapping.map_claim(self.stg_claim)

    # ------------------------------------------------------------ curated
    @cached_property
    def policy_master(self) -> DataFrame:
        """Curated policies: one day's load is missing and one day's premiums are wrong."""
        day = F.dayofmonth("ISSUE_DATE")
        return mapping.policy_rows(self.trn_policy).filter(day != LOST).withColumn(
            "PREMIUM_AMOUNT",
            F.when(day == WRONG, F.col("PREMIUM_AMOUNT") + 100)
            .otherwise(F.col("PREMIUM_AMOUNT")).cast("decimal(12,2)"),
        )

    @cached_property
    def claim_master(self) -> DataFrame:
        """Curated claims: a lost day, a wrong status, and a day moved to unknown policies."""
        day = F.dayofmonth("CLAIM_DATE")
        return mapping.claim_rows(self.trn_claim).filter(day != LOST).withColumns({
            "CLAIM_STATUS": F.when(day == WRONG, "Pending").otherwise(F.col("CLAIM_STATUS")),
            "POLICY_ID": F.when(day == FOREIGN, F.concat(F.lit("X"), "POLICY_ID"))
            .otherwise(F.col("POLICY_ID")),
        })

    @cached_property
    def customer_360(self) -> DataFrame:
        """Totals of the curated detail; the totals of one market segment are stale."""
        people = mapping.customer_rows(self.trn_customer)
        totals = customer_totals(self.policy_master, self.claim_master)
        stale = F.col("CUSTOMER_NAME") == "UNKNOWN"
        return with_totals(people, totals).withColumn(
            "TOTAL_PREMIUM",
            F.when(stale, F.col("TOTAL_PREMIUM") + F.lit("0.02").cast("decimal(15,2)"))
            .otherwise(F.col("TOTAL_PREMIUM")).cast("decimal(15,2)"),
        )

    def tables(self) -> dict[str, DataFrame]:
        """All layers by table name, as the saved checks expect them."""
        return {
            "STG_CUSTOMER": self.stg_customer, "STG_POLICY": self.stg_policy,
            "STG_CLAIM": self.stg_claim, "TRN_CUSTOMER": self.trn_customer,
            "TRN_POLICY": self.trn_policy, "TRN_CLAIM": self.trn_claim,
            "CUSTOMER_360": self.customer_360, "POLICY_MASTER": self.policy_master,
            "CLAIM_MASTER": self.claim_master,
        }

    # ------------------------------------------------------------ logs and catalog
    @cached_property
    def run_log(self) -> DataFrame:
        """One execution per event: user = test, event type = status, day = run."""
        status = code(F.col("event_type"), RUN_STATUS, "PASS")
        test = F.format_string("TC-%04d", "user_id")
        return self.table("events").select(
            F.format_string("E%012d", "event_id").alias("execution_id"),
            F.concat(F.lit("RUN_"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
            test.alias("test_case_id"),
            F.concat(F.lit("Check "), "user_id").alias("test_name"),
            F.when(F.col("user_id") < 100, "PRJ-1").otherwise("PRJ-2").alias("project_id"),
            self._folder(F.col("user_id")).alias("folder_path"),
            F.dayofmonth("ts").alias("test_version_no"),
            F.col("ts").alias("run_ts"),
            status.alias("status"),
            F.when(status == "PASS", 0).otherwise(F.floor("value")).cast("bigint")
            .alias("failed_record_count"),
        )

    @staticmethod
    def _folder(user: Column) -> Column:
        return (
            F.when(user < 40, "/Staging").when(user < 80, "/Regression")
            .when(user < 120, "/Regression/Nightly").otherwise("/Reg_Archive")
        )

    @cached_property
    def failure_log(self) -> DataFrame:
        """Failing executions with a column name taken from the event; clicks have none."""
        column = F.when(F.col("event_type") == "error", "PREMIUM_AMOUNT").otherwise(
            F.when(F.hour("ts") < 12, "CLAIM_STATUS")
        )
        return self.table("events").filter(F.col("event_type").isin("error", "view")).select(
            F.format_string("F%012d", "event_id").alias("failure_id"),
            F.format_string("E%012d", "event_id").alias("execution_id"),
            F.format_string("TC-%04d", "user_id").alias("test_case_id"),
            F.concat(F.lit("K"), "user_id").alias("business_key"),
            column.alias("column_name"),
            F.col("ts").alias("failed_ts"),
        )

    @cached_property
    def catalog(self) -> DataFrame:
        """One saved check per part; names repeat within a brand, some fields are blank."""
        size, kind = F.col("p_size"), F.col("p_type")
        two_sided = kind.isin("ECONOMY", "STANDARD")
        query = F.concat(
            F.lit("SELECT ':no' AS a, x::string -- :never\nFROM "), F.upper("p_brand"),
            F.lit(" WHERE size > :size_"), F.col("p_size"), F.lit(" AND kind = :"),
            F.lower("p_type"), F.lit(" /* :gone */ AND batch = :batch_id"),
        )
        return self.table("part").select(
            F.format_string("TC-%04d", "p_partkey").alias("test_case_id"),
            F.when(size == 7, " ").otherwise(F.col("p_name")).alias("test_name"),
            F.when(kind == "ECONOMY", "SOURCE_TARGET_COMPARE").when(
                kind == "STANDARD", "ROW_COUNT_MATCH").when(kind == "SMALL", "SQL_ROWCOUNT")
            .when(kind == "LARGE", "STATUS_COLUMN").when(kind == "PROMO", "INFORMATIONAL")
            .otherwise("OTHER").alias("test_type"),
            F.col("p_brand").alias("folder_id"),
            F.lit("Medium").alias("severity"),
            F.when(two_sided, query).alias("source_sql"),
            F.when(two_sided & (size != 9), F.lit("SELECT * FROM t WHERE d = :run_date"))
            .alias("target_sql"),
            F.when(~two_sided, query).alias("validation_sql"),
            F.when(size < 45, "ID").otherwise(" , ").alias("key_columns"),
            F.lit("").alias("compare_columns"),
            F.lit(0).cast("decimal(18,8)").alias("tolerance"),
            (F.col("p_size") != 11).alias("is_active"),
            F.col("p_size").alias("version_no"),
        )

"""
Keyed table changes as whole-table expressions.

Plain Parquet has no row updates, so each function returns the table's new
content; the caller writes it to a new place (see ``sources.tables``).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT, NEW, OLD = "kept", "new", "old"  # what becomes of a row in an upsert; an old one is replaced by a new one


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """
    Full-row upsert: source rows replace target rows with the same key.

    Source keys must be unique (promotion checks that first). A small source is
    broadcast by its measured size, and then the target is not shuffled.
    """
    kept = target.join(source.select(*keys), keys, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def upsert_in_place(stacked: DataFrame, key: str, lies_by: list[str], name: str = "_is") -> DataFrame:
    """
    ``upsert`` of target and source in one frame, whose column ``name`` tells target rows (KEPT) and source rows (NEW)
    apart: target rows that have a source row of their key become OLD. Rows that lie by columns ``lies_by``, which
    follow from the key, are matched where they lie. A NULL key is in nobody's place.
    """
    met = F.max(F.col(name) == NEW).over(Window.partitionBy(*lies_by, key))
    replaced = (F.col(name) == KEPT) & F.col(key).isNotNull() & F.col("_met")
    return stacked.withColumn("_met", met).withColumn(name, F.when(replaced, OLD).otherwise(F.col(name))).drop("_met")


def replace_batch(target: DataFrame, batch: DataFrame, batch_id: str) -> DataFrame:
    """Target with the rows of one batch replaced; other batches stay as they are."""
    return target.filter(~F.col("BATCH_ID").eqNullSafe(F.lit(batch_id))).unionByName(
        batch.select(*target.columns)
    )


def set_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns on the rows a condition selects; NULL conditions select nothing."""
    return target.withColumns(
        {
            c: F.when(condition, v.cast(target.schema[c].dataType)).otherwise(F.col(c))
            for c, v in values.items()
        }
    )


def update_from(
    target: DataFrame, source: DataFrame, keys: list[str], columns: dict[str, str]
) -> DataFrame:
    """
    Update ``columns`` (target name -> source name) from the source row with the
    same key; rows without one are untouched, and a NULL in the source is a value.
    Of source rows that share a key, the one with the smallest values counts.
    """
    given = source.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.struct(*[F.col(s).alias(f"_new_{t}") for t, s in columns.items()]).alias("_new"),
    )
    new = given.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_new").alias("_new")).select(
        *[f"_k{i}" for i in range(len(keys))], "_new.*", F.lit(True).alias("_hit"))
    on = reduce(and_, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)])
    joined = target.join(new, on, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}").cast(target.schema[c].dataType))
            .otherwise(F.col(c))
            .alias(c)
            if c in columns
            else F.col(c)
            for c in target.columns
        ]
    )


def customer_totals(policies: DataFrame, claims: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """
    Premium and claim totals per customer, or of some ``customers`` only.

    Claims are summed per policy before they meet the policies, so a policy that
    holds a large share of all claims joins as a single row, and the two totals
    never multiply each other. Sums travel, not rows: customers are picked among the totals,
    which Spark does ahead of the sums where they are few enough to be sent to every task.
    """
    per_policy = claims.filter(F.col("POLICY_ID").isNotNull()).groupBy("POLICY_ID").agg(
        F.count("CLAIM_ID").alias("_claims"), F.sum("CLAIM_AMOUNT").alias("_amount")
    )
    totals = (
        policies.select("POLICY_ID", "CUSTOMER_ID", "PREMIUM_AMOUNT")
        .join(per_policy, "POLICY_ID", "left")
        .groupBy("CUSTOMER_ID")
        .agg(
            F.sum("PREMIUM_AMOUNT").alias("TOTAL_PREMIUM"),
            F.coalesce(F.sum("_claims"), F.lit(0)).alias("TOTAL_CLAIMS"),
            F.sum("_amount").alias("TOTAL_CLAIM_AMOUNT"),
        )
        .filter(F.col("CUSTOMER_ID").isNotNull())
    )
    return totals if customers is None else totals.join(customers.select("CUSTOMER_ID"), "CUSTOMER_ID", "left_semi")


def with_totals(customers: DataFrame, totals: DataFrame) -> DataFrame:
    """Recompute every customer's totals; customers without detail get zeros."""
    money = F.lit(0).cast("decimal(15,2)")
    return customers.drop("TOTAL_PREMIUM", "TOTAL_CLAIMS", "TOTAL_CLAIM_AMOUNT").join(
        totals, "CUSTOMER_ID", "left"
    ).withColumns(
        {
            "TOTAL_PREMIUM": F.coalesce(F.col("TOTAL_PREMIUM").cast("decimal(15,2)"), money),
            "TOTAL_CLAIMS": F.coalesce(F.col("TOTAL_CLAIMS"), F.lit(0)).cast("bigint"),
            "TOTAL_CLAIM_AMOUNT": F.coalesce(
                F.col("TOTAL_CLAIM_AMOUNT").cast("decimal(15,2)"), money
            ),
        }
    )


def merge_file_list(old: Column, new: Column) -> Column:
    """Comma list of file names with a new name appended once."""
    before = F.filter(F.split(F.coalesce(old, F.lit("")), ", "), lambda f: f != "")
    after = F.when(F.coalesce(new, F.lit("")) != "", F.array(new)).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.array_distinct(F.concat(before, after)), ", ")

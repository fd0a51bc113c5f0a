"""Row counts per table, in total and for one batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Report order.
LAYER_TABLES = (
    ("Staging", ("STG_CUSTOMER", "STG_POLICY", "STG_CLAIM")),
    ("Transformation", ("TRN_CUSTOMER", "TRN_POLICY", "TRN_CLAIM")),
    ("Curated", ("CUSTOMER_360", "POLICY_MASTER", "CLAIM_MASTER")),
)
CURATED_FROM = {
    "CUSTOMER_360": ("TRN_CUSTOMER", "CUSTOMER_ID"),
    "POLICY_MASTER": ("TRN_POLICY", "POLICY_ID"),
    "CLAIM_MASTER": ("TRN_CLAIM", "CLAIM_ID"),
}


def record_counts(tables, batch_id: str) -> DataFrame:
    """
    layer, table, total and batch rows. Curated tables have no batch column: a
    row belongs to the batch when the batch's transformed rows carry its key.
    """
    parts = []
    for layer, names in LAYER_TABLES:
        for name in names:
            rows = tables[name]
            if name in CURATED_FROM:
                trn, key = CURATED_FROM[name]
                keys = tables[trn].filter(F.col("BATCH_ID") == batch_id).select(key).distinct()
                in_batch = rows.select(key).join(keys.withColumn("_hit", F.lit(True)), key, "left")
                hit = F.col("_hit").isNotNull()
            else:
                in_batch, hit = rows.select("BATCH_ID"), F.col("BATCH_ID") == batch_id
            parts.append(
                in_batch.agg(
                    F.lit(layer).alias("layer"),
                    F.lit(name).alias("table_name"),
                    F.count(F.lit(1)).alias("total_rows"),
                    F.count_if(F.coalesce(hit, F.lit(False))).alias("batch_rows"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def counts_by_layer(counts: DataFrame) -> DataFrame:
    """Subtotal per layer and a grand total over ``record_counts``."""
    return (
        counts.rollup("layer", "table_name")
        .agg(F.sum("total_rows").alias("total_rows"), F.sum("batch_rows").alias("batch_rows"))
        .select(
            F.coalesce("layer", F.lit("(all)")).alias("layer"),
            F.coalesce("table_name", F.lit("(all)")).alias("table_name"),
            "total_rows",
            "batch_rows",
        )
    )

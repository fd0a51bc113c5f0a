"""
The training-data pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept. All but the last
return the columns of ``documents``; a document that the mix takes three times comes three times.

A stage that chooses rows first stores them with a key of their own, by which the operator's findings come back to
them: different documents may share a doc_id or have none, and each is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import mixing, near, packing, perplexity, pii
from plumbline.llm.queries import packing_digest, vocabulary
from plumbline.session import scratch


def _keyed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a stored number of their own, and its name: ``_row``, or longer where that is taken."""
    held = {c.lower() for c in docs.columns}
    row = next(name for k in range(len(held) + 1) if (name := "_row" + "_" * k) not in held)
    # Compressed well: these copies stay on disk until the pipeline is done.
    docs.withColumn(row, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(
        path := scratch(spark, "keyed"))
    return spark.read.parquet(path), row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go."""
    keyed, row = _keyed(spark, docs)
    kept = perplexity.quality(keyed, id=row).filter("kept").select(F.col("doc_id").alias("~kept"))
    return keyed.join(kept, F.col(row) == F.col("~kept"), "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, of equal ones any one."""
    keyed, row = _keyed(spark, docs)
    linked = near.join(keyed, id=row).select(F.col("doc_id").alias("~linked"), F.col("class_id").alias("~class"))
    named = linked.join(keyed.select(row, "doc_id"), F.col(row) == F.col("~linked"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col(row).alias("row")))  # a null id comes last
    kept = named.groupBy("~class").agg(first.alias("first")).select(F.col("first.row").alias("~kept"))
    return keyed.join(kept, F.col(row) == F.col("~kept"), "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; ``n_chars`` follows the text."""
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    keyed, row = _keyed(spark, docs)
    taken = mixing.mix_sources(keyed, keep=(row,)).filter("taken > 0").select(
        F.col(row).alias("~taken"), (F.col("taken") / F.col("size")).cast("int").alias("~times"))
    times = keyed.join(taken, F.col(row) == F.col("~taken"))
    return times.withColumn("~copy", F.explode(F.sequence(F.lit(1), F.col("~times")))).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing_digest(packing.pack(docs, vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed_sequences),
]

ORACLE_SQL = None  # neither the language model nor the tokenizer is SQL; tests/llm has brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := scratch(spark, "pipeline"))
            docs = spark.read.parquet(path)
    return docs

"""Named sources, so the two sides of a check may come from different systems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[str], DataFrame]


class Sources:
    """``sources.read("warehouse", "ORDERS")`` picks the reader by name."""

    def __init__(self, default: str = "default"):
        self.default, self._readers = default, {}

    def add(self, name: str, reader: Reader) -> Sources:
        self._readers[name.strip().lower()] = reader
        return self

    def read(self, name: str | None, table: str) -> DataFrame:
        key = (name or self.default).strip().lower()
        if key not in self._readers:
            known = ", ".join(sorted(self._readers)) or "none"
            raise LookupError(f"Unknown source '{key}'. Configured: {known}")
        return self._readers[key](table)


def parquet_folder(spark: SparkSession, folder: str) -> Reader:
    return lambda table: spark.read.parquet(f"{folder}/{table}.parquet")


def catalog(spark: SparkSession) -> Reader:
    return spark.table


def jdbc(spark: SparkSession, url: str, partition: dict | None = None, **options) -> Reader:
    """
    A relational source. Give ``partition`` (column, lower, upper, count) for a
    large table; without it the whole result arrives through one connection.
    """
    def read(table: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
        for key, value in options.items():
            reader = reader.option(key, value)
        if partition:
            reader = (
                reader.option("partitionColumn", partition["column"])
                .option("lowerBound", partition["lower"])
                .option("upperBound", partition["upper"])
                .option("numPartitions", partition["count"])
            )
        return reader.load()

    return read

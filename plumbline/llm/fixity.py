"""
Merkle fixity audit of web archive files.

Each record of an archive file is a leaf: its place and the SHA-256 of its bytes. Leaves are hashed
into fixed ranges of the file's offsets, ranges into ranges ``FANOUT`` times as long, up to one root
per file. Two replicas are compared from the roots down: only branches whose hashes differ are
looked into, until the records are found that are changed, missing or additional.

A range holds at most ``RANGE`` bytes of different record starts, an inner node at most ``FANOUT``
children, so no group grows with the archive. Leaf hashes are stored once; the descent
reads those instead of the records.

Defined results: a null file or offset is a value of its own; a null body is hashed as no bytes and
differs from an empty one; records equal in file, offset, length and bytes are one leaf with a count, so
a record stored twice differs from one stored once; empty replicas give no differences; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import scratch

RANGE = 1 << 18
FANOUT = 32
HEIGHT = 5  # levels of ranges: up to RANGE * FANOUT**4 bytes, 256 GiB, in one file

FILE, OFFSET, LENGTH, BODY = "file", "offset", "length", "body"


def warc_record(url: Column, body: Column) -> Column:
    """A WARC resource record of a page as bytes."""
    data = body.cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.coalesce(F.octet_length(data), F.lit(0)).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), F.coalesce(data, F.lit(b"")), F.lit(b"\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, hash, copies) of all records, stored."""
    spark = records.sparkSession
    found = records.select(
        FILE, OFFSET, LENGTH, F.coalesce(F.sha2(BODY, 256), F.lit("none")).alias("hash"),
    ).groupBy(FILE, OFFSET, LENGTH, "hash").agg(F.count(F.lit(1)).alias("copies"))
    found.write.parquet(path := scratch(spark, "fixity-leaves"))
    return spark.read.parquet(path)


def tree(leaf: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT, height: int = HEIGHT) -> list[DataFrame]:
    """(file, part, hash) of each level: ranges of offsets first, one root per file last; stored."""
    spark = leaf.sparkSession
    line = F.concat_ws(":", F.coalesce(F.col(OFFSET).cast("string"), F.lit("")), F.coalesce(
        F.col(LENGTH).cast("string"), F.lit("")), "hash", F.col("copies").cast("string"))
    part = F.floor(F.coalesce(F.col(OFFSET), F.lit(-1)) / F.lit(range_bytes)).cast("bigint")
    level = leaf.select(FILE, part.alias("part"), F.coalesce(F.col(OFFSET), F.lit(-1)).alias("at"), line.alias("line"))
    out = []
    for k in range(height):
        if k:
            up = F.lit(0).cast("bigint") if k == height - 1 else F.floor(F.col("part") / F.lit(fanout)).cast("bigint")
            level = out[-1].select(FILE, up.alias("part"), F.col("part").alias("at"), F.concat_ws(
                ":", F.col("part").cast("string"), "hash").alias("line"))
        level = level.groupBy(FILE, "part").agg(F.sha2(F.concat_ws(
            "\n", F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])), 256).alias("hash"))
        level.write.parquet(path := scratch(spark, "fixity-level"))
        out.append(spark.read.parquet(path))
    return out


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hash differs between two levels, or that only one of them has."""
    one = a.select(*keys, F.col("hash").alias("_a"))
    two = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("hash").alias("_b"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = one.join(two, same, "full")
    return joined.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        *[F.when(F.col("_a").isNotNull(), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys])


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT,
          height: int = HEIGHT) -> DataFrame:
    """
    Where two replicas (file, offset, length, body) differ.

    Returns (file, offset, problem, first_hash, second_hash): ``changed`` where both have records at an
    offset but not the same, else ``missing`` or ``additional`` from the first one's view. Hashes
    of several records at one offset are joined by commas.
    """
    spark = first.sparkSession
    a, b = leaves(first), leaves(second)
    up, vp = tree(a, range_bytes, fanout, height), tree(b, range_bytes, fanout, height)
    suspects = _differing(up[-1], vp[-1], [FILE, "part"])
    for k in range(height - 2, -1, -1):
        suspects.write.parquet(path := scratch(spark, "fixity-suspects"))
        held = spark.read.parquet(path).select(F.col(FILE).alias("_f"), F.col("part").alias("_p"))
        parent = F.lit(0).cast("bigint") if k == height - 2 else F.floor(F.col("part") / F.lit(fanout)).cast("bigint")
        below = F.col(FILE).eqNullSafe(F.col("_f")) & (parent == F.col("_p"))
        suspects = _differing(up[k].join(held, below, "left_semi"), vp[k].join(held, below, "left_semi"), [FILE, "part"])
    suspects.write.parquet(path := scratch(spark, "fixity-suspects"))
    held = spark.read.parquet(path).select(F.col(FILE).alias("_f"), F.col("part").alias("_p"))
    part = F.floor(F.coalesce(F.col(OFFSET), F.lit(-1)) / F.lit(range_bytes)).cast("bigint")
    inside = F.col(FILE).eqNullSafe(F.col("_f")) & (part == F.col("_p"))

    def at_offsets(leaf: DataFrame) -> DataFrame:
        one = F.concat_ws(":", F.coalesce(F.col(LENGTH).cast("string"), F.lit("")), "hash", F.col("copies").cast("string"))
        return leaf.join(held, inside, "left_semi").groupBy(FILE, OFFSET).agg(
            F.concat_ws(",", F.sort_array(F.collect_list(one))).alias("hash"),
            F.concat_ws(",", F.sort_array(F.collect_list("hash"))).alias("shown"))

    one = at_offsets(a).select(FILE, OFFSET, F.col("hash").alias("_a"), F.col("shown").alias("first_hash"))
    two = at_offsets(b).select(F.col(FILE).alias("_file"), F.col(OFFSET).alias("_offset"), F.col("hash").alias("_b"),
                               F.col("shown").alias("second_hash"))
    both = one.join(two, F.col(FILE).eqNullSafe(F.col("_file")) & F.col(OFFSET).eqNullSafe(F.col("_offset")), "full")
    mine = F.col("_a").isNotNull()
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        F.when(mine, F.col(FILE)).otherwise(F.col("_file")).alias(FILE),
        F.when(mine, F.col(OFFSET)).otherwise(F.col("_offset")).alias(OFFSET),
        F.when(F.col("_b").isNull(), "missing").when(~mine, "additional").otherwise("changed").alias("problem"),
        "first_hash", "second_hash")

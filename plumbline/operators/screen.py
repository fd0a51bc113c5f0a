"""
Reconciliation by digests: rows are compared in full only where digests differ.

The first pass shuffles the key and a 128-bit digest of each row's canonical cells, so text and typed columns
can agree too. Per key and side it keeps counts and exclusive ors of digests: buffers of fixed width, which
Spark aggregates by hashing, before and after the shuffle. A key with one row on each side and equal digests
is done; the other keys are written to the shared folder. The second pass fetches the rows of these keys only. Those with
a row per side at most are brought together by a hash join; only keys that repeat go through the grouping
that finds their smallest rows. Most loads differ in few rows, so wide columns hardly ever move.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import canonical
from plumbline.operators.check import Check
from plumbline.operators.reconcile import _N_SRC, _N_TGT, _SRC, _TGT, Sides, _group_sides, reconcile
from plumbline.session import scratch

# Rows are filtered by a broadcast of the keys to be compared, if these take at most so many bytes.
BROADCAST_BYTES = 32 << 20


def reconcile_screened(
    source: DataFrame,
    target: DataFrame,
    keys: list[str],
    compare: list[str] | None = None,
    tolerance: float = 0,
) -> Check:
    """
    Same result as ``reconcile``, for sides that can be read twice. Runs the digest pass when called; if most
    keys turn out to differ, the full comparison reads everything once more.
    """
    sides = Sides.of(source, target, keys, compare)
    suspects, seen = _suspects(sides)
    agreed, single, repeated = seen["agreed"], seen["single"], seen["repeated"]
    if single + repeated > agreed:
        return reconcile(source, target, keys, compare, tolerance)
    small = seen["bytes"] <= BROADCAST_BYTES
    parts = []
    if single or not repeated:
        left, right = (_only(side, suspects.filter("NOT repeated"), small, sides) for side in (sides.left, sides.right))
        parts.append(_lone_pairs(left, right, sides.key_names))
    if repeated:
        left, right = (_only(side, suspects.filter("repeated"), small, sides) for side in (sides.left, sides.right))
        parts.append(_group_sides(left, right, sides.key_names))
    rest = sides.check(reduce(DataFrame.unionByName, parts), tolerance)
    # Every agreeing key is one row on each side and one match.
    plus = F.lit(agreed).cast("bigint")
    measures = dict(rest.measures)
    for name in ("source_row_count", "target_row_count", "matched_record_count"):
        measures[name] = F.coalesce(rest.measures[name], F.lit(0)) + plus
    return Check(rest.frame, measures, rest.to_failures, compared_columns=tuple(sides.columns))


def digests(sides: Sides) -> DataFrame:
    """Per key: rows on each side, and the exclusive or of all its rows' digests (0 for two equal ones)."""

    def side(df: DataFrame, row: str, own: int, source: bool) -> DataFrame:
        cells = [canonical(F.col(row)[f"c{i}"], *(types[own], types[1 - own])) for i, types in enumerate(sides.types)]
        # NULLs do not change a hash, so their positions are hashed as well.
        parts = [c.isNull() for c in cells] + cells
        return df.select(
            *sides.key_names, F.xxhash64(F.lit(0), *parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"),
            F.lit(int(source)).cast("bigint").alias("s"), F.lit(int(not source)).cast("bigint").alias("t"))

    return side(sides.left, _SRC, 0, True).unionByName(side(sides.right, _TGT, 1, False)).groupBy(*sides.key_names).agg(
        F.sum("s").alias(_N_SRC), F.sum("t").alias(_N_TGT), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))


def _suspects(sides: Sides) -> tuple[DataFrame, dict[str, int]]:
    """Keys that need a full comparison, and how many agree, are single, repeat; bytes of the keys."""
    spark, names = sides.left.sparkSession, sides.key_names
    repeated = (F.col(_N_SRC) > 1) | (F.col(_N_TGT) > 1)
    agrees = (F.col(_N_SRC) == 1) & (F.col(_N_TGT) == 1) & (F.col("x1") == 0) & (F.col("x2") == 0)
    types = {n: sides.left.schema[n].dataType for n in names}
    size = sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names if isinstance(types[n], (T.StringType, T.BinaryType))),
               F.lit(16 * len(names)))
    path, seen = scratch(spark, "suspects"), Observation()
    # Counted in the writing stage itself, where each partition is counted once.
    digests(sides).observe(
        seen, F.count_if(agrees).alias("agreed"), F.count_if(~agrees & ~repeated).alias("single"),
        F.count_if(repeated).alias("repeated"), F.coalesce(F.sum(F.when(~agrees, size)), F.lit(0)).alias("bytes"),
    ).filter(~agrees).select(*names, repeated.alias("repeated")).write.parquet(path)
    schema = T.StructType([T.StructField(n, types[n]) for n in names] + [T.StructField("repeated", T.BooleanType())])
    return spark.read.schema(schema).parquet(path), seen.get


def _same_key(names: list[str], other: list[str]):
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names, other)])


def _only(rows: DataFrame, suspects: DataFrame, small: bool, sides: Sides) -> DataFrame:
    """Rows whose key is a suspect."""
    other = [f"{n}_" for n in sides.key_names]
    keys = suspects.select(*[F.col(n).alias(o) for n, o in zip(sides.key_names, other)])
    keys = F.broadcast(keys) if small else keys.hint("shuffle_hash")
    return rows.join(keys, _same_key(sides.key_names, other), "left_semi")


def _lone_pairs(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """One row per key, for keys with one row on a side at most."""
    other = [f"{n}_" for n in names]
    left = left.withColumn(_N_SRC, F.lit(1).cast("bigint"))
    right = right.withColumn(_N_TGT, F.lit(1).cast("bigint")).withColumnsRenamed(dict(zip(names, other)))
    both = left.join(right.hint("shuffle_hash"), _same_key(names, other), "full_outer")
    none = F.lit(0).cast("bigint")
    return both.select(
        *[F.coalesce(a, b).alias(a) for a, b in zip(names, other)],
        F.coalesce(_N_SRC, none).alias(_N_SRC), F.coalesce(_N_TGT, none).alias(_N_TGT), _SRC, _TGT)

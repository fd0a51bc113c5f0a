"""
Source-to-target reconciliation on a business key.

Both sides are stacked and grouped once by key, so every row is shuffled at most
once and the grouping's map-side half collapses repeated keys before the shuffle:
a key that holds a third of all rows reaches its reducer as one row per input
partition. NULL keys group together, which is also how they should match.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import equal, flat, kind_of, render, text_of
from plumbline.operators.check import Check

# The wording reports rely on.
VALUE_MISMATCH = "VALUE_MISMATCH"
MISSING_IN_TARGET = "MISSING_IN_TARGET"
EXTRA_IN_TARGET = "EXTRA_IN_TARGET"
DUPLICATE_KEY = "DUPLICATE_KEY"
ROW_COUNT_MISMATCH = "ROW_COUNT_MISMATCH"

_N_SRC, _N_TGT, _SRC, _TGT = "_n_src", "_n_tgt", "_src", "_tgt"


def reconcile(
    source: DataFrame,
    target: DataFrame,
    keys: list[str],
    compare: list[str] | None = None,
    tolerance: float = 0,
    laid_out: bool = False,
) -> Check:
    """
    Match source rows to target rows on ``keys`` and diff the other columns.

    ``compare`` defaults to every shared non-key column, in source order. ``laid_out`` says that a side may lie by
    its keys already, from a join or because it is kept so; it is then not shuffled again.
    """
    sides = Sides.of(source, target, keys, compare)
    return sides.check(_group_sides(sides.left, sides.right, sides.key_names, laid_out), tolerance)


@dataclass
class Sides:
    """Both sides with columns ``_k0``, ``_k1``, … to match by and their compared columns in one struct."""

    left: DataFrame
    right: DataFrame
    keys: list[str]
    columns: list[str]
    types: list[tuple[T.DataType, T.DataType]]  # of the compared columns in the structs

    @classmethod
    def of(cls, source: DataFrame, target: DataFrame, keys: list[str], compare: list[str] | None = None) -> Sides:
        src, tgt = _by_upper_name(source), _by_upper_name(target)
        keys = [k.strip().upper() for k in keys]
        columns = _columns_to_compare(src, tgt, keys, compare)
        src_keys, tgt_keys = _key_columns(src, tgt, keys)
        names = [f"_k{i}" for i in range(len(keys))]
        left = source.select(*[c.alias(n) for c, n in zip(src_keys, names)], _row_struct(src, columns).alias(_SRC))
        right = target.select(*[c.alias(n) for c, n in zip(tgt_keys, names)], _row_struct(tgt, columns).alias(_TGT))
        return cls(left, right, keys, columns, [
            tuple(flat(F.lit(None), fields[c].dataType)[1] for fields in (src, tgt)) for c in columns])

    @property
    def key_names(self) -> list[str]:
        return [f"_k{i}" for i in range(len(self.keys))]

    def check(self, pairs: DataFrame, tolerance: float = 0) -> Check:
        """The check of one row per key: its rows on each side, how many, and one of them."""
        keys, key_names, columns, field_types = self.keys, self.key_names, self.columns, self.types
        both = (F.col(_N_SRC) > 0) & (F.col(_N_TGT) > 0)
        differs = [
            both
            & ~equal(F.col(_SRC)[f"c{i}"], st, F.col(_TGT)[f"c{i}"], tt, tolerance)
            for i, (st, tt) in enumerate(field_types)
        ]
        any_diff = reduce(or_, differs, F.lit(False))
        dup_src, dup_tgt = F.col(_N_SRC) > 1, F.col(_N_TGT) > 1
        missing, extra = F.col(_N_TGT) == 0, F.col(_N_SRC) == 0

        failures_in_pair = sum(
            (c.cast("int") for c in (dup_src, dup_tgt, missing, extra, *differs)), F.lit(0)
        )
        measures = {
            "source_row_count": F.sum(_N_SRC),
            "target_row_count": F.sum(_N_TGT),
            "matched_record_count": F.count_if(both & ~any_diff),
            "failed_record_count": F.sum(failures_in_pair),
        }

        def to_failures(frame: DataFrame) -> DataFrame:
            key_types = [frame.schema[n].dataType for n in key_names]
            business_key = F.concat_ws(
                " | ", *[render(F.col(n), t) for n, t in zip(key_names, key_types)]
            )
            key_list = ",".join(keys)
            cases = [
                _failure(dup_src, key_list, "1 row", _rows(_N_SRC), DUPLICATE_KEY,
                         _appears(_N_SRC, "SOURCE")),
                _failure(dup_tgt, key_list, "1 row", _rows(_N_TGT), DUPLICATE_KEY,
                         _appears(_N_TGT, "TARGET")),
                _failure(missing, key_list, "record present in target", "<NOT FOUND>",
                         MISSING_IN_TARGET, "Record exists in source but was not loaded into target"),
                _failure(extra, key_list, "<NOT IN SOURCE>", "record present in target",
                         EXTRA_IN_TARGET, "Record exists in target but has no matching source record"),
            ]
            for i, (name, (st, tt)) in enumerate(zip(columns, field_types)):
                cases.append(
                    _failure(F.col(f"_d{i}"), name, render(F.col(_SRC)[f"c{i}"], st),
                             render(F.col(_TGT)[f"c{i}"], tt), VALUE_MISMATCH,
                             f"{name} does not match between source and target")
                )
            # The comparisons get a projection of their own, so that they run once and the
            # generated code of each step stays small enough for the JVM to compile.
            flagged = frame.withColumns({f"_d{i}": d for i, d in enumerate(differs)})
            amiss = [dup_src, dup_tgt, missing, extra, *[F.col(f"_d{i}") for i in range(len(columns))]]
            return (
                flagged.filter(reduce(or_, amiss)).select(business_key.alias("business_key"),
                               F.explode(F.array(*cases)).alias("f"))
                .filter(F.col("f").isNotNull())
                .select("business_key", "f.*")
            )

        return Check(pairs, measures, to_failures, compared_columns=tuple(columns))


def match_row_counts(
    source: DataFrame, target: DataFrame, tolerance: float = 0
) -> Check:
    """Compare two counts; each side is a count in one cell, or rows to be counted."""
    nothing = F.lit(None).cast("bigint")
    sides = count_of(source, "s").withColumn("t", nothing).unionByName(
        count_of(target, "t").withColumn("s", nothing)
    )
    counts = sides.agg(F.max("s").alias("s"), F.max("t").alias("t"))
    agree = F.abs(F.col("s") - F.col("t")) <= F.lit(tolerance)
    measures = {
        "source_row_count": F.sum("s"),
        "target_row_count": F.sum("t"),
        "matched_record_count": F.sum(F.when(agree, F.least("s", "t")).otherwise(0)),
        "failed_record_count": F.sum((~agree).cast("int")),
    }

    def to_failures(frame: DataFrame) -> DataFrame:
        s, t = F.col("s").cast("string"), F.col("t").cast("string")
        return frame.filter(~agree).select(
            F.lit("<row count>").alias("business_key"),
            F.lit("ROW_COUNT").alias("column_name"),
            s.alias("expected_value"),
            t.alias("actual_value"),
            F.lit(ROW_COUNT_MISMATCH).alias("failure_type"),
            F.concat(F.lit("Source returned "), s, F.lit(" row(s), target returned "), t).alias(
                "failure_reason"
            ),
        )

    return Check(counts, measures, to_failures)


def count_of(df: DataFrame, name: str) -> DataFrame:
    """One row: the single cell's integer when there is exactly one, else the row count."""
    if len(df.columns) != 1:
        return df.agg(F.count(F.lit(1)).alias(name))
    only = F.col(f"`{df.columns[0]}`")
    dt = df.schema[0].dataType
    if isinstance(dt, T.BooleanType):
        cell = only.cast("bigint")
    elif kind_of(dt) == "num":
        cell = only.try_cast("bigint")
    elif kind_of(dt) == "text":  # '12' counts as 12; '12.5' is a row, not a count
        cell = F.when(only.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(only).try_cast("bigint"))
    else:
        cell = F.lit(None).cast("bigint")
    rows = F.count(F.lit(1))
    return df.agg(
        F.when(rows == 1, F.coalesce(F.max(cell), rows)).otherwise(rows).alias(name)
    )


# ---------------------------------------------------------------------------
def _by_upper_name(df: DataFrame) -> dict[str, T.StructField]:
    return {f.name.upper(): f for f in df.schema.fields}


def _columns_to_compare(src, tgt, keys, compare) -> list[str]:
    """The asked columns, or all shared ones that are not keys; all named must be on both sides."""
    if not keys:
        raise ValueError("Matching needs at least one key column.")
    wanted = [c.strip().upper() for c in compare or ()]
    lacking = {
        side: names for side, held in (("source", src), ("target", tgt))
        if (names := [c for c in [*keys, *wanted] if c not in held])
    }
    if lacking:
        told = ", ".join(f"{side} has no {'/'.join(names)}" for side, names in lacking.items())
        raise ValueError(f"Both sides need every key and compared column: {told}.")
    return wanted or [c for c in src if c in tgt and c not in keys]


def _key_columns(src, tgt, keys) -> tuple[list[Column], list[Column]]:
    """Key parts both sides can be grouped by: native where types allow, else rendered text."""
    left, right = [], []
    for k in keys:
        a, b = src[k], tgt[k]
        ca, cb = F.col(f"`{a.name}`"), F.col(f"`{b.name}`")
        if _integral(a.dataType) and _integral(b.dataType):
            ca, cb = ca.cast("bigint"), cb.cast("bigint")
        elif a.dataType != b.dataType or not isinstance(a.dataType, (T.StringType, T.DateType)):
            ca, cb = text_of(ca, a.dataType), text_of(cb, b.dataType)
        left.append(ca)
        right.append(cb)
    return left, right


def _integral(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _row_struct(cols: dict[str, T.StructField], columns: list[str]) -> Column:
    parts = [
        flat(F.col(f"`{cols[c].name}`"), cols[c].dataType)[0].alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    return F.struct(*(parts or [F.lit(True).alias("present")]))


def _group_sides(left: DataFrame, right: DataFrame, key_names: list[str], each: bool = False) -> DataFrame:
    """
    Stack both sides and group once; a repeated key keeps its smallest row. With ``each`` the sides are
    grouped before they are stacked: groups meet where they lie, so a side that lies by key already stays there.
    """
    src_type, tgt_type = left.schema[_SRC].dataType, right.schema[_TGT].dataType
    if each:
        none, rows = F.lit(0).cast("bigint"), F.count(F.lit(1))
        lefts = left.groupBy(*key_names).agg(rows.alias(_N_SRC), F.min(_SRC).alias(_SRC)).withColumns(
            {_N_TGT: none, _TGT: F.lit(None).cast(tgt_type)})
        rights = right.groupBy(*key_names).agg(rows.alias(_N_TGT), F.min(_TGT).alias(_TGT)).withColumns(
            {_N_SRC: none, _SRC: F.lit(None).cast(src_type)})
        return lefts.unionByName(rights).groupBy(*key_names).agg(
            F.sum(_N_SRC).alias(_N_SRC),
            F.sum(_N_TGT).alias(_N_TGT),
            F.min(_SRC).alias(_SRC),
            F.min(_TGT).alias(_TGT),
        )
    stacked = left.withColumn(_TGT, F.lit(None).cast(tgt_type)).unionByName(
        right.withColumn(_SRC, F.lit(None).cast(src_type))
    )
    return stacked.groupBy(*key_names).agg(
        F.count(_SRC).alias(_N_SRC),
        F.count(_TGT).alias(_N_TGT),
        F.min(_SRC).alias(_SRC),
        F.min(_TGT).alias(_TGT),
    )


def _failure(when: Column, column, expected, actual, kind: str, reason) -> Column:
    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.when(
        when,
        F.struct(
            as_col(column).alias("column_name"),
            as_col(expected).alias("expected_value"),
            as_col(actual).alias("actual_value"),
            F.lit(kind).alias("failure_type"),
            as_col(reason).alias("failure_reason"),
        ),
    )


def _rows(count_column: str) -> Column:
    return F.concat(F.col(count_column).cast("string"), F.lit(" rows"))


def _appears(count_column: str, side: str) -> Column:
    return F.concat(
        F.lit("Business key appears "), F.col(count_column).cast("string"),
        F.lit(f" times in the {side} result set"),
    )

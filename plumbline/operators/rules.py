"""Rule queries: rows that violate a rule become uniform failure rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import NULL_TEXT, strip
from plumbline.operators.check import Check

RULE_VIOLATION = "RULE_VIOLATION"

# Result columns with a known meaning, in order of preference.
ALIASES = {
    "business_key": ("BUSINESS_KEY", "KEY", "ID"),
    "column_name": ("COLUMN_NAME", "COLUMN", "FIELD"),
    "expected_value": ("EXPECTED_VALUE", "EXPECTED"),
    "actual_value": ("ACTUAL_VALUE", "ACTUAL"),
    "failure_reason": ("FAILURE_REASON", "REASON", "MESSAGE"),
}
STATUS_ALIASES = ("STATUS", "RESULT", "VALIDATION_STATUS")
PASS_TOKENS = ("PASS", "OK", "TRUE", "1")


def rule_failures(rows: DataFrame, test_name: str) -> DataFrame:
    """Project a rule's result onto the failure columns, by alias or by position."""
    found = {target: _aliased(rows, names) for target, names in ALIASES.items()}
    names = rows.columns
    key = found["business_key"] or names[0]
    second = names[1] if len(names) > 1 else names[0]
    if found["failure_reason"]:
        reason = _shown(rows, found["failure_reason"])
    else:
        cells = [F.concat(F.lit(f"{n}="), _shown(rows, n)) for n in names]
        reason = F.concat(F.lit(f"{test_name}: "), F.concat_ws(", ", *cells))

    def shown_or(target: str, default: str) -> Column:
        return _shown(rows, found[target]) if found[target] else F.lit(default)

    return rows.select(
        _shown(rows, key).alias("business_key"),
        shown_or("column_name", second).alias("column_name"),
        shown_or("expected_value", "").alias("expected_value"),
        shown_or("actual_value", "").alias("actual_value"),
        F.lit(RULE_VIOLATION).alias("failure_type"),
        reason.alias("failure_reason"),
    )


def no_rows(rows: DataFrame, test_name: str) -> Check:
    """Passes when the rule query returns nothing."""
    n = F.count(F.lit(1))
    return Check(
        rows,
        {"source_row_count": n, "failed_record_count": n},
        lambda frame: rule_failures(frame, test_name),
        all_fail=True,
    )


def status_column(rows: DataFrame, test_name: str) -> Check:
    """Passes when every row's status is a pass token; NULL fails."""
    status = _aliased(rows, STATUS_ALIASES)
    if status is None:
        raise ValueError(
            "A STATUS_COLUMN test must return a column named STATUS "
            f"(got: {', '.join(rows.columns) or 'no columns'})."
        )
    token = F.upper(strip(F.col(f"`{status}`").cast("string")))
    good = F.coalesce(token.isin(*PASS_TOKENS), F.lit(False))
    return Check(
        rows,
        {
            "source_row_count": F.count(F.lit(1)),
            "matched_record_count": F.count_if(good),
            "failed_record_count": F.count_if(~good),
        },
        lambda frame: rule_failures(frame.filter(~good), test_name),
    )


def informational(rows: DataFrame, test_name: str) -> Check:
    """Always passes; the rows are the report."""
    n = F.count(F.lit(1))
    return Check(
        rows,
        {"source_row_count": n, "matched_record_count": n},
        lambda frame: rule_failures(frame, test_name).limit(0),
        always_passes=True,
    )


@dataclass(frozen=True)
class RowRule:
    """A rule decided by one row alone, so many of them can share a scan."""

    test_id: str
    violated: Column
    key: Column
    column: str
    expected: Column | str
    actual: Column
    reason: str


def pack(rows: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """
    Every violation of every rule in one pass over ``rows``.

    Each row yields an array with one slot per rule; clean rows are dropped
    before the array is built. NULL conditions count as "not violated", as in a
    WHERE clause.
    """
    def as_text(v) -> Column:
        return v.cast("string") if isinstance(v, Column) else F.lit(v)

    broken = [F.coalesce(r.violated, F.lit(False)) for r in rules]
    slots = [
        F.when(
            bad,
            F.struct(
                F.lit(r.test_id).alias("test_id"),
                F.coalesce(as_text(r.key), F.lit(NULL_TEXT)).alias("business_key"),
                F.lit(r.column).alias("column_name"),
                F.coalesce(as_text(r.expected), F.lit(NULL_TEXT)).alias("expected_value"),
                F.coalesce(as_text(r.actual), F.lit(NULL_TEXT)).alias("actual_value"),
                F.lit(RULE_VIOLATION).alias("failure_type"),
                F.lit(r.reason).alias("failure_reason"),
            ),
        )
        for bad, r in zip(broken, rules)
    ]
    any_broken = broken[0]
    for bad in broken[1:]:
        any_broken = any_broken | bad
    return (
        rows.filter(any_broken)
        .select(F.explode(F.array(*slots)).alias("f"))
        .filter(F.col("f").isNotNull())
        .select("f.*")
    )


# ---------------------------------------------------------------------------
def _aliased(df: DataFrame, names: Sequence[str]) -> str | None:
    by_upper = {}
    for c in df.columns:
        by_upper.setdefault(c.upper(), c)
    return next((by_upper[n] for n in names if n in by_upper), None)


def _shown(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType)):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(NULL_TEXT))

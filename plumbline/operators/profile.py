"""Column profiles and candidate keys, for any table, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import ISO_DATE, ISO_TIMESTAMP
from plumbline.functions.values import flat, kind_of, text_of

SHOWN = 60
SKETCH_ERROR = 0.02  # relative standard deviation of a sketched distinct count
_NEARLY = 0.9  # of the rows: a column with fewer values by its sketch, five deviations off, is no key
_LONG = 64  # longer values are told apart by their SHA-256 digest


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """
    One row per column: kind, nulls, distinct values, uniqueness, range, example.

    Counts, ranges and kinds are one shuffle-free aggregate. Exact distinct
    counts group (column, value) pairs, pre-aggregated before their shuffle, so
    a value that fills a third of a column travels once per input partition.
    ``approximate`` replaces them by a sketch in the first aggregate; a column
    is then never reported as a key.
    """
    fields = [(i, f) for i, f in enumerate(df.schema.fields)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in fields:
        c, dt = flat(F.col(f"`{f.name}`"), f.dataType)
        low, high = (F.min(c), F.max(c))
        aggs += [
            F.count(c).alias(f"v{i}"),
            text_of(low, dt).alias(f"lo{i}"),
            text_of(high, dt).alias(f"hi{i}"),
            F.bool_and(_date_like(c, dt)).alias(f"d{i}"),
            F.bool_and(_time_like(c, dt)).alias(f"t{i}"),
            F.bool_and(_whole(c, dt)).alias(f"w{i}"),
        ]
        if approximate:
            aggs.append(F.approx_count_distinct(c, SKETCH_ERROR).alias(f"u{i}"))
    wide = df.agg(*aggs)

    slots = []
    for i, f in fields:
        given = F.col(f"v{i}")
        kind = _kind(f.dataType, given, i)
        nulls = F.col("n") - given
        # Parts per thousand, rounded half up, so the result is exact.
        pct = F.when(
            F.col("n") > 0, F.floor((nulls * 2000 + F.col("n")) / (F.col("n") * 2)) / 10
        ).otherwise(F.lit(0.0))
        ranged = (given > 0) & (kind != "text")
        slots.append(F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            kind.alias("kind"),
            F.col("n").alias("row_count"),
            nulls.alias("null_count"),
            pct.alias("null_pct"),
            F.when(ranged, F.substring(f"lo{i}", 1, SHOWN)).otherwise("").alias("min_value"),
            F.when(ranged, F.substring(f"hi{i}", 1, SHOWN)).otherwise("").alias("max_value"),
            F.coalesce(F.substring(f"lo{i}", 1, SHOWN), F.lit("")).alias("example"),
            (F.col(f"u{i}") if approximate else F.lit(None).cast("bigint")).alias("_sketch"),
        ))
    facts = wide.select(F.explode(F.array(*slots)).alias("x")).select("x.*")
    if approximate:
        return facts.select(
            "position", "column_name", "kind", "row_count", "null_count", "null_pct",
            F.col("_sketch").alias("distinct_count"), F.lit(False).alias("is_key"),
            "min_value", "max_value", "example",
        )
    return facts.drop("_sketch").join(F.broadcast(distinct_counts(df)), "position", "left").select(
        "position", "column_name", "kind", "row_count", "null_count", "null_pct",
        F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count"),
        F.coalesce(
            (F.col("row_count") > 0) & (F.col("null_count") == 0) & (F.col("_most") == 1),
            F.lit(False),
        ).alias("is_key"),
        "min_value", "max_value", "example",
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """
    position, distinct_count and the most frequent value's count; one row per column.

    Values are compared in their own type: whole numbers, dates and instants as a
    long, floating point as a double, the rest (wall-clock times too) as text.
    """
    slots = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        slots.append(F.struct(F.lit(i).alias("position"), *_typed_value(c, f.dataType)))
    return (
        df.select(F.explode(F.array(*slots)).alias("x")).select("x.*")
        .filter("l is not null or d is not null or s is not null")
        .groupBy("position", "l", "d", "s").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("position")
        .agg(F.count(F.lit(1)).alias("distinct_count"), F.max("_n").alias("_most"))
    )


def _typed_value(c: Column, dt: T.DataType) -> list[Column]:
    """The value in exactly one of a long, a double and a text field."""
    kind = kind_of(dt)
    whole = real = text = None
    if isinstance(dt, T.DecimalType):
        small = dt.precision <= 18
        whole = (c * 10**dt.scale).cast("bigint") if small else None
        text = None if small else c.cast("string")
    elif isinstance(dt, (T.DoubleType, T.FloatType)):
        real = c.cast("double")
    elif kind in ("num", "bool"):
        whole = c.cast("bigint")
    elif kind == "date":
        whole = F.unix_date(c).cast("bigint")
    elif isinstance(dt, T.TimestampType):
        whole = F.unix_micros(c)
    else:
        text = text_of(c, dt)
        text = F.when(F.length(text) > _LONG, F.sha2(text, 256)).otherwise(text)

    def typed(value, type_: str, name: str) -> Column:
        return (F.lit(None) if value is None else value).cast(type_).alias(name)

    return [typed(whole, "bigint", "l"), typed(real, "double", "d"), typed(text, "string", "s")]


def candidate_keys(profiled: DataFrame) -> DataFrame:
    return profiled.filter("is_key").select("column_name")


def find_keys(df: DataFrame) -> tuple[dict[str, int], list[str]]:
    """
    Rows, columns and columns with NULLs of a table, and the columns without NULLs or repeated values.

    One pass counts and sketches every column; values are grouped exactly only for the columns whose sketch
    nearly reaches the number of rows. Ranges, kinds and other columns' values are not looked at. Runs when called.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = flat(F.col(f"`{f.name}`"), f.dataType)[0]
        aggs += [F.count(c).alias(f"v{i}"), F.approx_count_distinct(c, SKETCH_ERROR).alias(f"u{i}")]
    seen = df.agg(*aggs).first()  # one row
    names = df.columns
    likely = [c for i, c in enumerate(names) if seen.n and seen[f"v{i}"] == seen.n and seen[f"u{i}"] >= _NEARLY * seen.n]
    facts = {"row_count": seen.n, "column_count": len(names),
             "columns_with_nulls": sum(seen[f"v{i}"] < seen.n for i in range(len(names)))}
    if not likely:
        return facts, []
    exact = distinct_counts(df.select(*[F.col(f"`{c}`") for c in likely])).filter("_most = 1").select("position")
    return facts, [likely[k] for k in sorted(r.position for r in exact.collect())]  # a row for each such column


def table_summary(profiled: DataFrame) -> DataFrame:
    return profiled.agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
        F.count_if("is_key").alias("candidate_keys"),
    )


# ---------------------------------------------------------------------------
def _is_text(dt: T.DataType) -> bool:
    return kind_of(dt) == "text"


def _date_like(c: Column, dt: T.DataType) -> Column:
    return c.rlike(ISO_DATE) if _is_text(dt) else F.lit(False)


def _time_like(c: Column, dt: T.DataType) -> Column:
    return (c.rlike(ISO_TIMESTAMP) & (F.length(c) > 10)) if _is_text(dt) else F.lit(False)


def _whole(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c == F.rint(c)
    if isinstance(dt, T.DecimalType):
        return c == F.floor(c)
    return F.lit(False)


def _kind(dt: T.DataType, given: Column, i: int) -> Column:
    base = kind_of(dt)
    if base == "bool":
        found = F.lit("boolean")
    elif isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        found = F.when(F.col(f"w{i}"), "integer").otherwise("decimal")
    elif base == "num":
        found = F.lit("integer")
    elif base == "date":
        found = F.lit("date")
    elif base == "ts":
        found = F.lit("timestamp")
    elif base == "text":
        found = F.when(F.col(f"d{i}"), "date").when(F.col(f"t{i}"), "timestamp").otherwise("text")
    else:
        found = F.lit("text")
    return F.when(given == 0, "empty").otherwise(found)

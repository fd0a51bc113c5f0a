from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import (
    is_blank,
    is_date_text,
    is_number_text,
    is_timestamp_text,
    strip,
    title_case,
)
from plumbline.functions.values import equal, render

D, TS = date(2024, 10, 31), datetime(2026, 8, 2, 22, 4)
NAN = float("nan")
EQUAL = [
    ("decimal(12,2)", Decimal("12000.00"), "double", 12000.0),
    ("string", "12000.00", "int", 12000),
    ("string", "Approved  ", "string", "Approved"),
    ("string", "\tx ", "string", "x"),
    ("string", None, "int", None),
    ("int", 1, "double", 1.0),
    ("string", "2024-10-31", "date", D),
    ("string", "2026-08-02 22:04:00", "timestamp_ntz", TS),
    ("string", "2026-08-02T22:04", "timestamp_ntz", TS),
    ("string", "2026-08-02 22:04:00.25", "string", "2026-08-02T22:04"),
    ("timestamp_ntz", TS.replace(microsecond=5), "timestamp_ntz", TS),
    ("string", "1e3", "int", 1000),
    ("string", "1.50", "string", "1.5"),
    ("string", "NaN", "string", "NaN"),
    ("double", NAN, "double", NAN),
    ("float", 0.1, "string", "0.1"),
    ("double", 1e25, "double", 1e25),
    ("boolean", True, "boolean", True),
    ("string", "0.15e1", "string", "1.50"),
    ("string", "-0.0", "int", 0),
    ("string", "1" + "0" * 45, "string", "1e45"),
    ("double", 1e25, "string", "10000000000000000000000000"),
    ("float", 0.1, "double", 0.1),
    ("double", 1e-20, "string", "1e-20"),
    ("string", "1e99999999999999999999", "string", "10.0e99999999999999999998"),
    ("string", "0e99999999999999999999", "int", 0),
    ("string", "1e" + "9" * 40, "string", "1.0E+00" + "9" * 40),
]
UNEQUAL = [
    ("int", 12000, "int", 10000),
    ("string", None, "string", "x"),
    ("string", "Approved", "string", "Pending"),
    ("date", D, "timestamp_ntz", datetime(2024, 10, 31)),
    ("string", "2024-10-31", "timestamp_ntz", datetime(2024, 10, 31)),
    ("string", "2024-10-30", "date", D),
    ("string", "2024-02-30 00:00", "string", "2024-02-30T00:00"),
    ("boolean", True, "int", 1),
    ("boolean", True, "string", "True"),
    ("string", "1_000", "int", 1000),
    ("int", None, "int", 0),
    ("string", "a b", "string", "ab"),
    ("string", "0.1234567890123456789", "string", "0.1234567890123456787"),
    ("double", 1e-20, "string", "0"),
    ("double", 1e-20, "float", 2e-19),
    ("string", "1" * 40, "string", "1" * 39 + "2"),
    ("double", 9007199254740992.0, "bigint", 9007199254740993),
    ("string", "1e99999999999999999999", "string", "1e99999999999999999998"),
    ("string", "1e" + "9" * 40, "string", "1e" + "9" * 39 + "8"),
    ("string", "1e-99999999999999999999", "string", "1e99999999999999999999"),
]


def compare(spark, a_type, a, b_type, b, tolerance=0):
    df = spark.createDataFrame([(a, b)], f"a {a_type}, b {b_type}")
    cell = equal(F.col("a"), df.schema["a"].dataType, F.col("b"), df.schema["b"].dataType,
                 tolerance)
    return df.select(cell.alias("r")).first().r


@pytest.mark.parametrize("expected,pairs", [(True, EQUAL), (False, UNEQUAL)])
def test_equality_is_typed_and_symmetric(spark, expected, pairs):
    for a_type, a, b_type, b in pairs:
        assert compare(spark, a_type, a, b_type, b) is expected, (a, b)
        assert compare(spark, b_type, b, a_type, a) is expected, (b, a)


def test_tolerance_is_inclusive(spark):
    assert compare(spark, "double", 100.004, "double", 100.001, 0.01)
    assert not compare(spark, "double", 100.05, "double", 100.00, 0.01)
    assert compare(spark, "string", "12000.004", "decimal(12,2)", Decimal("12000.00"), 0.01)
    assert compare(spark, "decimal(12,2)", Decimal("1.01"), "int", 1, 0.01)
    assert not compare(spark, "int", None, "int", 1, 5)
    assert compare(spark, "double", 1e21, "double", 1e21 + 131072, 1e9)
    assert not compare(spark, "double", 1e21, "double", 1e21 + 131072, 1e3)
    assert not compare(spark, "double", 1e-20, "string", "3e-20", 1e-20)
    assert compare(spark, "double", 1e-20, "string", "1.5e-20", 1e-20)


def test_numbers_out_of_decimal_range_render_whole(spark):
    df = spark.sql("SELECT 1e-20D AS a, 2e-19D AS b, 1.5D AS c, 1e30D AS d")
    shown = df.select(*[render(F.col(c), df.schema[c].dataType) for c in "abcd"]).first()
    assert list(shown) == ["1.0E-20", "2.0E-19", "1.5", "1000000000000000000000000000000"]


@pytest.mark.parametrize("type_,value,text", [
    ("double", 12000.0, "12000"), ("double", 1e10, "10000000000"), ("double", 0.5, "0.5"),
    ("int", 1200, "1200"), ("decimal(12,2)", Decimal("12000.00"), "12000"),
    ("decimal(12,2)", Decimal("0.00"), "0"), ("decimal(5,0)", Decimal("100"), "100"),
    ("string", "1200.00", "1200.00"), ("string", None, "<NULL>"), ("boolean", True, "True"),
    ("date", D, "2024-10-31"), ("timestamp_ntz", TS, "2026-08-02 22:04:00"),
    ("timestamp_ntz", TS.replace(microsecond=250000), "2026-08-02 22:04:00.250000"),
    ("double", 1e25, "10000000000000000000000000"),
])
def test_rendering_is_plain(spark, type_, value, text):
    df = spark.createDataFrame([(value,)], f"v {type_}")
    assert df.select(render(F.col("v"), df.schema["v"].dataType)).first()[0] == text


def test_text_predicates(spark):
    cases = [  # text, blank, number, date, timestamp
        (None, True, None, False, False), ("", True, False, False, False),
        (" \t", True, False, False, False), ("12k", False, False, False, False),
        (" 1e3 ", False, True, False, False), ("-.5", False, True, False, False),
        ("2024-02-29", False, False, True, True), ("2024-02-30", False, False, False, False),
        ("2024-1-5", False, False, False, False), ("2024", False, True, False, False),
        ("31/12/2024", False, False, False, False), ("0000-01-01", False, False, False, False),
        ("2024-02-29T23:59", False, False, False, True),
        ("2024-02-29 24:00:00", False, False, False, False),
        ("yesterday", False, False, False, False),
    ]
    df = spark.createDataFrame(
        [(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    c = F.col("s")
    got = df.select("i", is_blank(c), is_number_text(c), is_date_text(c), is_timestamp_text(c))
    for r in got.collect():
        assert tuple(r)[1:] == cases[r.i][1:], cases[r.i]


def test_title_case_breaks_at_punctuation(spark):
    df = spark.createDataFrame([("new-delhi",), ("o'NEIL st. mary",), ("a - b",), ("île-é",)],
                               "s string")
    assert [r[0] for r in df.select(title_case(F.col("s"))).collect()] == [
        "New-Delhi", "O'Neil St. Mary", "A - B", "Île-É"]
    assert spark.range(1).select(strip(F.lit("　 x\x1f"))).first()[0] == "x"


def test_doubles_and_short_decimals_meet_before_their_digits_are_parsed(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from plumbline.functions.values import equal

    df = spark.sql("SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DECIMAL(15,2)) AS b FROM VALUES ('0.1', 0.1), ('-0.0', 0.0), "
                   "('9999999999999.99', 9999999999999.99), ('9999999999999.98', 9999999999999.99), ('0.30000000000000004', 0.3), "
                   "('NaN', 0.0), (NULL, 0.0), (NULL, NULL), ('1', NULL), ('Infinity', 1.0) AS x(a, b)")
    same = equal(F.col("a"), T.DoubleType(), F.col("b"), T.DecimalType(15, 2))
    assert [r.s for r in df.select(same.alias("s")).collect()] == [True, True, True, False, False, False, False, True, False, False]
    # More digits than a double holds are compared as they are spelled.
    wide = spark.sql("SELECT 0.12345678901234568D AS a, CAST('0.123456789012345678' AS DECIMAL(18,18)) AS b")
    assert not wide.select(equal(F.col("a"), T.DoubleType(), F.col("b"), T.DecimalType(18, 18))).first()[0]
    assert "cast(b as double)" in df.select(same).columns[0].lower()

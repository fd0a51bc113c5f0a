"""
Typed value equality and rendering.

Column types are known when the plan is built, so each pair of columns gets the
cheapest comparison that has the right meaning; nothing is decided per row
unless one side is text. Text means whatever it spells: a number, a date, a
timestamp, or else itself without surrounding white space.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import ISO_TIMESTAMP, NULL_TEXT, NUMBER, strip

EXACT = "decimal(38,18)"  # what most numbers fit; others compare by their digits or as doubles
SMALLEST_EXACT = 1e-18
FITS_EXACT = r"^[+-]?0*\d{0,20}(\.\d{0,18}0*)?$"  # a number spelled without exponent, of that many digits

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.NullType):
        return "null"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, _INTEGRAL) or isinstance(dt, _FLOATING) or isinstance(dt, T.DecimalType):
        return "num"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "ts"
    if isinstance(dt, T.BinaryType):
        return "bin"
    if isinstance(dt, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return "nested"
    return "text"


def flat(c: Column, dt: T.DataType) -> tuple[Column, T.DataType]:
    """Nested values become JSON text; everything else passes through."""
    if kind_of(dt) == "nested":
        return F.to_json(c), T.StringType()
    return c, dt


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def exact(c: Column, dt: T.DataType, into: str = EXACT) -> Column:
    """A number as a decimal of the digits it prints; NULL when they do not all fit."""
    if isinstance(dt, _FLOATING):  # widening 0.1f would expose its binary tail
        fits = c.cast("string").try_cast(into)
        return F.when(fits.cast(dt) == c, fits)  # the digits a double prints are its own
    if isinstance(dt, T.DecimalType) and dt.scale > 18:
        fits = c.try_cast(into)
        return F.when(fits.try_cast(dt) == c, fits)
    return c.try_cast(into)


def _spelled(s: Column) -> Column:
    """A number's stripped text as a decimal; NULL when its digits do not all fit."""
    by_digits = _let(s.try_cast(EXACT), lambda x: F.when(digits(x.cast("string")) == digits(s), x))
    return F.when(s.rlike(FITS_EXACT), s.try_cast(EXACT)).when(s.rlike("[eE]"), by_digits)


def _same_digits(a: Column, b: Column) -> Column:
    """Whether two texts spell the same number; NULL when one spells none."""
    return _let(F.transform(F.array(a, b), digits), lambda d: F.get(d, F.lit(0)) == F.get(d, F.lit(1)))


def digits(text: Column) -> Column:
    """
    Sign, digits and power of ten of a number's text: 1.50 and 0.15E1 -> 15e-1, any zero -> 0.

    NULL for anything that does not spell a finite number. Nothing is rounded at any length. Every step is
    bound once, so the expression stays small and an array of texts costs no more than one. A power of more than 30 digits
    is kept as spelled, beside what the digits add to it.
    """
    def canonical(n: Column) -> Column:
        value = F.rtrim(n["first"], F.lit("0"))
        moved = F.length(n["first"]) - F.length(value) - n["after"]
        power = F.when(n["power"] == "", F.lit(0)).otherwise(n["power"].try_cast("decimal(30,0)")) + moved
        told = F.coalesce(power.cast("string"), F.concat(n["power"], F.lit("+"), moved.cast("string")))
        return F.when(value == "", "0").otherwise(F.concat(n["sign"], value, F.lit("e"), told))

    def parts(s: Column) -> Column:
        mantissa = F.regexp_replace(s, "^[+-]|[eE].*$", "")
        return F.struct(
            F.when(s.startswith("-"), "-").otherwise("").alias("sign"),
            F.ltrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0")).alias("first"),
            F.length(F.regexp_extract(mantissa, r"\.(\d*)", 1)).alias("after"),
            F.regexp_replace(F.regexp_extract(s, r"[eE]([+-]?\d+)$", 1), r"^\+?(-?)0*(?=\d)", "$1").alias("power"),
        )

    return _let(strip(text), lambda s: F.when(s.rlike(NUMBER), _let(parts(s), canonical)))


def _plain(number: Column) -> Column:
    """Decimal text without trailing zeros: 12000.00 -> 12000, 1200 stays 1200."""
    s = number.cast("string")
    return F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)


def _clock(ts: Column) -> Column:
    """Timestamp text to the second."""
    return F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 19)


def text_of(c: Column, dt: T.DataType) -> Column:
    """Plain text of a value for logs and keys; NULL stays NULL."""
    c, dt = flat(c, dt)
    if isinstance(dt, _INTEGRAL) or isinstance(dt, T.StringType):
        return c.cast("string")
    if isinstance(dt, T.DecimalType):
        return c.cast("string") if dt.scale == 0 else _plain(c)
    kind = kind_of(dt)
    if kind == "num":
        return F.coalesce(
            _plain(exact(c, dt)), _plain(exact(c, dt, "decimal(38,0)")), c.cast("string")
        )
    if kind == "bool":
        return F.when(c, "True").when(~c, "False")
    if kind == "ts":  # a fraction is always shown with six digits
        s = c.cast("timestamp_ntz").cast("string")
        return F.when(F.length(s) > 19, F.rpad(s, 26, "0")).otherwise(s)
    if kind == "bin":
        return F.hex(c)
    return c.cast("string")


def render(c: Column, dt: T.DataType) -> Column:
    """Plain text of a value, NULL spelled out."""
    return F.coalesce(text_of(c, dt), F.lit(NULL_TEXT))


def canonical(c: Column, dt: T.DataType, other: T.DataType) -> Column:
    """
    A value to be hashed: two sides that give the same one are ``equal``, whatever their types.

    Equal values may still give different ones (1.50 and '1.5'), so only agreement proves something.
    """
    kind, against = kind_of(dt), kind_of(other)
    if dt == other:
        return c
    if kind == against and kind != "num":
        return c.cast("timestamp_ntz") if kind == "ts" else c.cast("string")
    if {kind, against} <= {"num", "text"} or {kind, against} in ({"date", "text"}, {"ts", "text"}):
        return text_of(c, dt)
    return F.concat(F.lit(f"{kind} "), text_of(c, dt))  # of such kinds only NULLs are equal


def equal(
    a: Column, a_type: T.DataType, b: Column, b_type: T.DataType, tolerance: float = 0
) -> Column:
    """Never-NULL boolean: same kind and same value, or both NULL."""
    a, a_type = flat(a, a_type)
    b, b_type = flat(b, b_type)
    ka, kb = kind_of(a_type), kind_of(b_type)

    if "null" in (ka, kb):
        return a.isNull() & b.isNull()
    if ka == kb == "num":
        return _numbers_equal(a, a_type, b, b_type, tolerance)
    if ka == kb == "ts":
        a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
        return F.when(a.eqNullSafe(b), True).otherwise(_clock(a).eqNullSafe(_clock(b)))
    if ka == kb and ka != "text":
        return a.eqNullSafe(b)
    if ka == "text":
        return _text_equals(a, b, b_type, tolerance)
    if kb == "text":
        return _text_equals(b, a, a_type, tolerance)
    return a.isNull() & b.isNull()


def _text_equals(text: Column, other: Column, other_type: T.DataType, tolerance) -> Column:
    """What the text spells against another text, number, date or timestamp."""
    kind = kind_of(other_type)
    s = strip(text)
    o = None
    if kind == "text":
        o = strip(other)
        same = [s == o, _moment(s) == _moment(o)]
    elif kind == "num":
        o = other.cast("string")
        same = [s == text_of(other, other_type)]
    elif kind == "date":
        same = [s == other.cast("string")]
    elif kind == "ts":
        same = [_moment(s) == _clock(other)]
    else:
        return text.isNull() & other.isNull()
    if o is not None:
        same.append(_near(s, o, tolerance) if tolerance else _same_digits(s, o))
    spelled = reduce(or_, [F.coalesce(c, F.lit(False)) for c in same])
    both_null = text.isNull() & other.isNull()
    # Identical text needs no parsing, and most values are identical.
    known = text.eqNullSafe(other) if kind == "text" else both_null
    return F.when(known, True).when(text.isNull() | other.isNull(), False).otherwise(spelled)


def _moment(s: Column) -> Column:
    """Clock text of a date with a time of day; NULL for anything else."""
    has_time = (F.length(s) > 10) & s.rlike(ISO_TIMESTAMP)
    return F.when(has_time, _clock(s.try_cast("timestamp_ntz")))


def _near(a: Column, b: Column, tolerance) -> Column:
    """Number texts at most the tolerance apart: exactly where both fit, else as doubles."""
    spelled = a.rlike(NUMBER) & b.rlike(NUMBER)
    wide = F.abs(a.try_cast("double") - b.try_cast("double")) <= F.lit(float(tolerance))
    if tolerance < SMALLEST_EXACT:
        return spelled & (wide | _same_digits(a, b))
    return spelled & F.coalesce(_apart(_spelled(a), _spelled(b), tolerance), wide)


def _apart(a: Column, b: Column, tolerance) -> Column:
    return F.abs(a - b) <= F.lit(f"{tolerance:.18f}").cast(EXACT)


def _fits_double(dt: T.DataType) -> bool:
    return isinstance(dt, T.DecimalType) and dt.precision <= 15 and 0 <= dt.scale


def _numbers_equal(a, a_type, b, b_type, tolerance) -> Column:
    floating = [isinstance(t, _FLOATING) for t in (a_type, b_type)]
    left, right = exact(a, a_type), exact(b, b_type)
    as_texts = _same_digits(a.cast("string"), b.cast("string"))
    if type(a_type) is type(b_type) or not any(floating):
        raw = a.eqNullSafe(b)
    elif all(floating):  # a float is the number it prints
        raw = a.cast("string").cast("double").eqNullSafe(b.cast("string").cast("double"))
    else:
        raw = (a.isNull() & b.isNull()) | F.coalesce(left == right, as_texts, F.lit(False))
        if all(isinstance(t, T.DoubleType) or _fits_double(t) for t in (a_type, b_type)):
            # The double nearest to so few digits prints just them, and most values agree.
            raw = F.when(a.cast("double") == b.cast("double"), True).otherwise(raw)
    if not tolerance:
        return raw
    wide = F.abs(a.cast("string").cast("double") - b.cast("string").cast("double")) <= F.lit(float(tolerance))
    finite = F.abs(a.cast("double")) + F.abs(b.cast("double")) < F.lit(float("inf"))
    near = finite & (wide if tolerance < SMALLEST_EXACT else F.coalesce(_apart(left, right, tolerance), wide))
    # Raw equality first: the subtraction then runs for differing rows only.
    return F.when(raw, True).otherwise(F.coalesce(near, F.lit(False)))

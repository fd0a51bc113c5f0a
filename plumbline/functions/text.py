"""Text expressions the checks and mapping rules share (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode counts as white space, plus the four ASCII separators.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
)

# How files spell dates, timestamps and numbers.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"

NULL_TEXT = "<NULL>"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """NULL, or nothing but white space; looks no further than the first other character."""
    return c.isNull() | (F.ltrim(c, F.lit(WHITESPACE)) == "")


def is_number_text(c: Column) -> Column:
    """The stripped text spells a finite number."""
    return strip(c).rlike(NUMBER)


def is_date_text(c: Column) -> Column:
    """YYYY-MM-DD and a day the calendar has (the cast alone would accept '2024')."""
    s = strip(c)
    return s.rlike(ISO_DATE) & ~s.startswith("0000") & s.try_cast("date").isNotNull()


def is_timestamp_text(c: Column) -> Column:
    """A date, optionally followed by a time of day."""
    s = strip(c)
    return (
        s.rlike(ISO_TIMESTAMP) & ~s.startswith("0000") & s.try_cast("timestamp_ntz").isNotNull()
    )


def standard_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def upper_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit("UNKNOWN"))


def title_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(title_case(F.trim(c)), F.lit("")), F.lit("UNKNOWN"))


def title_case(c: Column) -> Column:
    """
    Capitalise the first letter after any non-alphanumeric character.

    ``initcap`` only breaks words at white space, so each separator is followed
    by a marker space for the call and the marker is dropped again. The marker
    pair (space + U+0001) cannot be mistaken for a space that was in the text.
    """
    marked = F.regexp_replace(c, r"([^\p{L}\p{N}\s])", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def decode(c: Column, table: dict[str, str], default: str = "Unknown") -> Column:
    """Look a trimmed, upper-cased code up in a small fixed table."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), standard_code(c)), F.lit(default))

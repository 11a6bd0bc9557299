"""Column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ustrip(col: Column) -> Column:
    """Python ``str.strip()``: remove Unicode white space at both ends.

    Spark's ``trim`` only removes spaces; ``(?U)\\s`` also covers tabs,
    carriage returns and the Unicode space separators; U+001C to U+001F are
    white space in Python only.
    """
    return F.regexp_replace(col, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def count_sub(col: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal one-character string."""
    return F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit("")))


def floor_div(col: Column, divisor: int) -> Column:
    """Python ``//`` for non-negative integers, as BIGINT."""
    return F.floor(col / F.lit(divisor)).cast("bigint")


def round_half_up(col: Column, digits: int) -> Column:
    """Rounding rule used wherever a number is printed: floor(x*10^d + 0.5)/10^d.

    Printing engines disagree on halves (``12.25`` → ``12.3`` or ``12.2``),
    so the value is rounded explicitly before it is formatted.
    """
    scale = 10 ** digits
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(float(scale))


def fixed_digits(col: Column, digits: int) -> Column:
    """Text of a number with exactly ``digits`` decimals after half-up rounding."""
    return F.format_string(f"%.{digits}f", round_half_up(col, digits))


def iso_text(ts: Column) -> Column:
    """Python ``datetime.isoformat()`` of a naive timestamp.

    Microseconds are printed only when they are not zero.
    """
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == F.lit("000000"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))

"""Whether a text value fits the numeric type it is declared with, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The numeric leaf types and the range of each integer type.
INTEGER_RANGES = {
    "byte": (0, 255),
    "char": (-128, 127),
    "word": (0, 65535),
    "short": (-32768, 32767),
    "dword": (0, 4294967295),
    "int": (-2147483648, 2147483647),
    "dword64": (0, 18446744073709551615),
    "int64": (-9223372036854775808, 9223372036854775807),
}
REAL_TYPES = ("float", "double")
_REAL = r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_blank(value: Column) -> Column:
    """NULL, empty or white space only."""
    return value.isNull() | ~value.rlike(r"\S")


def is_integer_type(kind: Column) -> Column:
    return kind.isin(*INTEGER_RANGES)


def is_numeric_type(kind: Column) -> Column:
    return kind.isin(*INTEGER_RANGES, *REAL_TYPES)


def plain_digits(value: Column) -> Column:
    """A whole number without spaces, leading zeros and the sign of zero; NULL if it isn't one."""
    bare = F.regexp_replace(F.trim(value), r"^(-?)0+(?=[0-9])", "$1")
    return F.when(F.trim(value).rlike(r"^-?[0-9]+$"), F.when(bare == "-0", F.lit("0")).otherwise(bare))


def fits(kind: Column, value: Column) -> Column:
    """True if ``value`` is a literal of the (lower-case) numeric type ``kind``, within its range; never NULL.

    Types that aren't numeric, NULL and blank values give False.
    """
    digits = plain_digits(value)
    number = F.when(F.length(digits) <= 21, digits).cast("decimal(38,0)")
    within = F.lit(False)
    for name, (low, high) in INTEGER_RANGES.items():
        within = F.when(kind == name, (number >= F.lit(str(low)).cast("decimal(38,0)")) & (number <= F.lit(str(high)).cast("decimal(38,0)"))).otherwise(within)
    real = F.trim(value).rlike(_REAL)
    return F.coalesce(F.when(kind.isin(*REAL_TYPES), real).when(is_integer_type(kind), within).otherwise(F.lit(False)), F.lit(False))


def as_double(value: Column) -> Column:
    """The value as a double, NULL where it is none; for values that fit."""
    return F.trim(value).try_cast("double")

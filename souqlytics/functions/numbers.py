"""B04, B07, B08 and rounding helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from souqlytics.functions.text import strip

# Eastern digits and their ASCII values (fixed values).
EASTERN_DIGITS = "۰۱۲۳۴۵۶۷۸۹" + "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789" + "0123456789"

# Boolean words (fixed values).
TRUE_WORDS = ("yes", "true", "1", "دارد")
FALSE_WORDS = ("no", "false", "0", "ندارد")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, EASTERN_DIGITS, ASCII_DIGITS)


def parse_amount(c: Column) -> Column:
    """Keep digits and dots, read as double; anything unreadable is null."""
    return F.regexp_replace(ascii_digits(c), r"[^0-9.]", "").try_cast("double")


def parse_id(c: Column) -> Column:
    """64-bit id; '7.0' counts as 7, fractions are null, large ids stay exact."""
    text = strip(c.cast("string"))
    as_double = text.try_cast("double")
    return F.coalesce(
        text.try_cast("bigint"), F.when(as_double == F.floor(as_double), as_double.try_cast("bigint"))
    )


def parse_whole(c: Column) -> Column:
    """A whole number from text or a fraction, halves to the even neighbour; large ones stay exact."""
    text = strip(c.cast("string"))
    return F.coalesce(text.try_cast("bigint"), F.bround(text.try_cast("double"), 0).try_cast("bigint"))


def parse_bool(c: Column) -> Column:
    """B08."""
    word = strip(F.lower(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct2(a: Column, b: Column) -> Column:
    """a / b as a percentage with two decimals, half up; null when b is zero."""
    return F.round(ratio(a, b) * 100, 2)

"""Jalali or Gregorian date text to timestamp, as column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from souqlytics.functions.numbers import ascii_digits
from souqlytics.functions.text import strip

# Jalali month names in calendar order (fixed values). The order also decides
# which name wins when one contains another.
JALALI_MONTHS = (
    "فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور",
    "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند",
)
# Years of the 33-year cycle whose last month has 30 days (fixed values).
LEAP_RESIDUES = (1, 5, 9, 13, 17, 22, 26, 30)

YEAR = r"(?U)\b(1[34]\d{2})\b"
DAY = r"(?U)\b(\d{1,2})\b"
# Tried in turn for text that is no ISO date.
OTHER_FORMATS = ("yyyy/M/d H:mm:ss", "yyyy/M/d", "M/d/yyyy", "d MMMM yyyy", "MMMM d, yyyy")


def jalali_to_date(y: Column, m: Column, d: Column) -> Column:
    """Gregorian date of a Jalali day, null when there is no such day."""
    jy = y - 979
    before_month = F.when(m <= 6, (m - 1) * 31).otherwise(186 + (m - 7) * 30)
    days = (
        jy * 365
        + F.floor(jy / 33) * 8
        + F.floor((F.pmod(jy, F.lit(33)) + 3) / 4)
        + before_month
        + d
        + 78
    )
    leap = F.pmod(y, F.lit(33)).isin(*LEAP_RESIDUES)
    length = F.when(m <= 6, 31).when((m <= 11) | leap, 30).otherwise(29)
    valid = m.between(1, 12) & (d >= 1) & (d <= length)
    return F.when(valid, F.date_add(F.lit("1600-01-01").cast("date"), days.cast("int")))


def parse_gregorian(text: Column, nanosecond_range: bool = True) -> Column:
    """ISO text first, then a few written forms.

    A time that 64-bit nanoseconds cannot hold (outside 1677-2262) is null, as the definitions
    have it; with ``nanosecond_range`` off it is kept.
    """
    iso = F.when(text.rlike(r"^\d{4}"), text.try_cast("timestamp"))
    parsed = F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in OTHER_FORMATS])
    if not nanosecond_range:
        return parsed
    in_range = (parsed >= F.lit("1677-09-22").cast("timestamp")) & (
        parsed < F.lit("2262-04-11").cast("timestamp")
    )
    return F.when(in_range, parsed)


def parse_date(c: Column, nanosecond_range: bool = True) -> Column:
    text = strip(c.cast("string"))
    month = reduce(
        lambda acc, im: acc.when(F.contains(text, F.lit(im[1])), im[0]),
        list(enumerate(JALALI_MONTHS, 1))[1:],
        F.when(F.contains(text, F.lit(JALALI_MONTHS[0])), 1),
    )
    year = ascii_digits(F.regexp_extract(text, YEAR, 1)).try_cast("int")
    day = ascii_digits(F.regexp_extract(F.regexp_replace(text, YEAR, ""), DAY, 1)).try_cast("int")
    complete = month.isNotNull() & year.isNotNull() & (day > 0)
    return (
        F.when(text.isin("", "nan", "None", "NaT"), None)
        .when(text.startswith("20"), parse_gregorian(text, nanosecond_range))
        .when(complete, jalali_to_date(year, month, day).cast("timestamp"))
        .otherwise(parse_gregorian(text, nanosecond_range))
    )

"""Numeric and date expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfvoice.schema import NEGATIVE_MAX, NEUTRAL_MAX

_NUMBER = r"^[ \t-\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t-\r]*$"
_INFINITY = r"^[ \t-\r]*[+-]?(?i:inf(inity)?)[ \t-\r]*$"

# Accepted date formats besides ISO, each with the shape of text it
# is tried on. A failed attempt is costly, so text of another shape skips it.
DATE_FORMATS = (
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("yyyy/M/d H:mm:ss", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d\d:\d\d$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d$"),
    ("MMMM d, yyyy", r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Z][a-z]+ \d{4}$"),
)


def coerce_rating(c: Column) -> Column:
    """Text to double; anything that is not a number becomes NULL, never NaN.

    A number too large for a double is missing as well, an explicit infinity is
    kept.
    """
    number = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    finite = F.when(F.abs(number) < float("inf"), number)
    return F.coalesce(finite, F.when(c.rlike(_INFINITY), F.trim(c).try_cast("double")))


def drop_nan(c: Column) -> Column:
    """NaN of a floating column as NULL (Spark orders NaN above all numbers)."""
    return F.when(~F.isnan(c), c)


def coerce_date(c: Column, formats: Sequence[tuple[str, str]] = DATE_FORMATS) -> Column:
    """Text to timestamp without zone; unreadable values become NULL.

    ``formats`` pairs each format with a pattern of the texts to try it on.
    """
    attempts = [c.try_cast("timestamp_ntz")]
    for fmt, shape in formats:
        parsed = F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")
        attempts.append(F.when(c.rlike(shape), parsed))
    return F.coalesce(*attempts)


def rating_bucket(rating: Column) -> Column:
    r = rating
    return (
        F.when(r <= NEGATIVE_MAX, F.lit("negative"))
        .when(r <= NEUTRAL_MAX, F.lit("neutral"))
        .when(r > NEUTRAL_MAX, F.lit("positive"))
    )


def month_bucket(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def half_even(c: Column, digits: int = 2) -> Column:
    """Round the scaled binary value half to even, the rule of numeric frames.

    ``bround`` works on the decimal text of the number instead and gives 1.02
    for 1.015, which lies below the tie once scaled.
    """
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """Share of ``whole`` in percent, unrounded without ``digits``; NULL for an empty whole."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return share if digits is None else half_even(share, digits)

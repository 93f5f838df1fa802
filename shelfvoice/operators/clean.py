"""Row-local cleaning of raw review tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvoice.functions.numbers import DATE_FORMATS, coerce_date, coerce_rating, drop_nan, rating_bucket
from shelfvoice.functions.text import trim_text
from shelfvoice.schema import PROCESSED, REQUIRED, REVIEW_TYPE, TEXT_COLUMNS, require_columns


def project_required(df: DataFrame) -> DataFrame:
    require_columns(df, REQUIRED)
    return df.select(*REQUIRED)


def coerce_types(df: DataFrame, date_formats: Sequence[tuple[str, str]] = DATE_FORMATS) -> DataFrame:
    """``Rating`` to double and ``Date`` to timestamp; bad values become NULL."""
    rating, date = F.col("Rating"), F.col("Date")
    kind = df.schema["Rating"].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        rating = drop_nan(rating.cast("double"))
    elif isinstance(kind, T.NumericType):
        rating = rating.cast("double")
    else:
        rating = coerce_rating(rating)
    if isinstance(df.schema["Date"].dataType, T.StringType):
        date = coerce_date(date, date_formats)
    else:
        date = date.cast("timestamp_ntz")
    return df.withColumns({"Rating": rating, "Date": date})


def trim_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: trim_text(F.col(f"`{c}`").cast("string")) for c in columns})


def trim_review_text(df: DataFrame) -> DataFrame:
    """Trim the text columns and the product key, which must meet trimmed brand keys."""
    return trim_columns(df, ["Asin", *TEXT_COLUMNS])


def add_review_type(df: DataFrame) -> DataFrame:
    return df.withColumn(REVIEW_TYPE, rating_bucket(F.col("Rating")))


def canonical_order(df: DataFrame) -> DataFrame:
    """Processed column order; absent columns are skipped."""
    return df.select(*[F.col(f"`{c}`") for c in PROCESSED if c in df.columns])

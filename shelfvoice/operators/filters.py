"""Row filters and filter reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfvoice.functions.numbers import half_even, percent
from shelfvoice.functions.text import nonblank
from shelfvoice.operators.positions import Key, rows_between
from shelfvoice.schema import MIN_TEXT_LENGTH, REVIEW_TYPE

FACETS = ["Brand", "Asin", "Rating", REVIEW_TYPE]
ALL_VALUES = "all"
ROW_RANGE = "row_range"


def facet_predicate(filters: dict) -> Column:
    """All facet conditions as one predicate; ``None`` and ``"all"`` set none."""
    tests = [F.col(f"`{c}`") == v for c, v in filters.items() if c in FACETS and v is not None and v != ALL_VALUES]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def row_range(df: DataFrame, start: int, end: int, order_by: str = "ID", dense: bool = False) -> DataFrame:
    """Rows ``[start, end)`` by position in ``order_by``.

    Dense ids make this a plain filter. Otherwise bounds around the range are
    selected first, so that only rows near it are sorted and written; rows that
    tie in ``order_by`` are ordered by a hash of the whole row.
    """
    if dense:
        return df.filter((F.col(order_by) > start) & (F.col(order_by) <= end))
    return rows_between(df, [Key(order_by)], start, end)


def filter_reviews(df: DataFrame, filters: dict | None) -> DataFrame:
    """Facet filter, then the optional row range over what is left."""
    filters = filters or {}
    kept = df.filter(facet_predicate(filters))
    if filters.get(ROW_RANGE):
        start, end = filters[ROW_RANGE]
        return row_range(kept, start, end)
    return kept


def min_length(df: DataFrame, column: str, n: int = MIN_TEXT_LENGTH) -> DataFrame:
    return df.filter(F.length(column) >= n)


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Keep listed values; an empty list keeps all rows."""
    return df.filter(F.col(f"`{column}`").isin(values)) if values else df


def of_review_type(df: DataFrame, review_type: str | None) -> DataFrame:
    """Review type in any letter case; ``None`` keeps all rows."""
    if review_type is None:
        return df
    return df.filter(F.lower(F.col(f"`{REVIEW_TYPE}`")) == review_type.lower())


def with_text(df: DataFrame, column: str) -> DataFrame:
    return df.filter(nonblank(F.col(f"`{column}`")))


def selectivity(df: DataFrame, condition: Column) -> DataFrame:
    """Rows kept by a condition, of how many, and their mean rating."""
    kept = F.coalesce(condition, F.lit(False))
    counts = df.agg(
        F.count_if(kept).alias("n_kept"),
        F.count(F.lit(1)).alias("n_all"),
        half_even(F.avg(F.when(kept, F.col("Rating"))), 1).alias("avg_rating"),
    )
    return counts.withColumn("pct_kept", percent(F.col("n_kept"), F.col("n_all"), 1))


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values that are not missing."""
    return df.select(F.col(f"`{column}`").alias("value")).dropna().distinct().orderBy("value")


def facets(df: DataFrame, columns: list[str] = FACETS) -> DataFrame:
    """All facets of a table from one scan, values as text."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("facet"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in columns
            if c in df.columns
        ]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .filter("value IS NOT NULL")
        .distinct()
        .orderBy("facet", "value")
    )

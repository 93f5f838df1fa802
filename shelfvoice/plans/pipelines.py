"""Jobs of the three entry points: clean, tag, and report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvoice.functions.numbers import DATE_FORMATS
from shelfvoice.operators import brands as B
from shelfvoice.operators import clean as C
from shelfvoice.operators import lexicon as L
from shelfvoice.operators.rowids import assign_row_ids, ids_in_file_order
from shelfvoice.schema import REQUIRED, require_columns
from shelfvoice.sources.readers import FILE_COLUMN, POSITION_COLUMNS


def number_rows(raw: DataFrame, order_by: list[str] | None) -> DataFrame:
    """Add ``ID`` in the given order, or in input order if the scan kept its position."""
    if order_by is not None:
        return assign_row_ids(raw, order_by, keep=REQUIRED)
    if FILE_COLUMN not in raw.columns:
        raise ValueError("name order_by, or read the table with its position")
    return ids_in_file_order(raw)


def process_reviews(
    raw: DataFrame,
    brands: DataFrame | None = None,
    *,
    order_by: list[str] | None = None,
    brand_order: Sequence[str] = tuple(POSITION_COLUMNS),
    date_formats: Sequence[tuple[str, str]] = DATE_FORMATS,
) -> DataFrame:
    """Raw review table to processed table.

    Without ``order_by`` ids follow the input order of the scan and the whole job
    is one pass over the reviews without a shuffle.
    """
    require_columns(raw, REQUIRED)
    numbered = number_rows(raw, order_by).select("ID", *REQUIRED)
    clean = (
        numbered.transform(C.coerce_types, date_formats).transform(C.trim_review_text).transform(C.add_review_type)
    )
    if brands is not None:
        clean = B.join_brands(clean, brands, list(brand_order), F.col("ID"))
    return C.canonical_order(clean)


def tag_reviews(reviews: DataFrame, lexicon_table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source rows with category flags, statistics per category and per keyword."""
    lexicon = L.Lexicon.of(lexicon_table)
    return (
        L.add_flags(reviews, lexicon),
        L.category_stats(reviews, lexicon),
        L.keyword_frequency(reviews, lexicon),
    )

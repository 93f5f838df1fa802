"""Brand lookup by product key, then by parent product key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfvoice.functions.numbers import percent
from shelfvoice.functions.text import blank_to_null, trim_text
from shelfvoice.operators.joins import lookup_left
from shelfvoice.schema import BRAND_REQUIRED, PARENT_ASIN, require_columns


def normalise_brands(brands: DataFrame) -> DataFrame:
    """Trimmed keys and names; a blank is missing. Other columns are kept."""
    require_columns(brands, BRAND_REQUIRED)
    names = [c for c in [*BRAND_REQUIRED, PARENT_ASIN] if c in brands.columns]
    return brands.withColumns({c: blank_to_null(F.col(f"`{c}`").cast("string")) for c in names})


def dedupe_brands(brands: DataFrame, order_by: list[str]) -> DataFrame:
    """One row per ``ASIN``, the last one in ``order_by``."""
    order = F.struct(*order_by)
    extra = [PARENT_ASIN] if PARENT_ASIN in brands.columns else []
    kept = brands.groupBy("ASIN").agg(F.max_by(F.struct("Brand", *extra, *order_by), order).alias("_last"))
    return kept.select("ASIN", "_last.*")


def brand_lookup(brands: DataFrame, order_by: list[str]) -> DataFrame:
    """Lookup ``(Asin, direct, parent)``: a product's own brand and its children's.

    Both rounds share one table keyed by product, so reviews are joined once.
    """
    last = dedupe_brands(normalise_brands(brands), order_by)
    none = F.lit(None).cast("string")
    own = F.struct(F.col("ASIN").alias("Asin"), F.col("Brand").alias("direct"), none.alias("inherited"))
    entries = [own]
    if PARENT_ASIN in brands.columns:
        parent = F.col(f"`{PARENT_ASIN}`").alias("Asin")
        entries.append(F.struct(parent, none.alias("direct"), F.col("Brand").alias("inherited")))
    keyed = last.select(F.posexplode(F.array(*entries)).alias("via_parent", "e"), F.struct(*order_by).alias("at"))
    # A product has one own row; of its children the last one names the brand.
    at_parent = F.when(F.col("via_parent") == 1, F.col("at"))
    return (
        keyed.filter("e.Asin IS NOT NULL")
        .groupBy(F.col("e.Asin").alias("Asin"))
        .agg(F.max("e.direct").alias("direct"), F.max_by("e.inherited", at_parent).alias("parent"))
    )


def join_brands(
    reviews: DataFrame, brands: DataFrame, order_by: list[str], spread_by: Column | None = None, use_parent: bool = True
) -> DataFrame:
    """Add ``Brand``; the number of reviews never changes.

    ``spread_by`` identifies a review (default its ``ID``); it is used only when
    the brand table is too large to broadcast.
    """
    lookup = brand_lookup(brands, order_by)
    spread = spread_by if spread_by is not None else F.col("ID")
    # Each brand row yields at most two lookup rows, so its size bounds the lookup's.
    joined = lookup_left(reviews, lookup, "Asin", spread, size_of=brands)
    found = F.coalesce("direct", "parent") if use_parent else F.col("direct")
    return joined.withColumn("Brand", found).drop("direct", "parent")


def brand_match_report(reviews: DataFrame, brands: DataFrame, order_by: list[str]) -> DataFrame:
    """Reviews matched in each round; reviews are counted per product before the join."""
    per_product = reviews.groupBy(trim_text(F.col("Asin")).alias("Asin")).agg(F.count(F.lit(1)).alias("n"))
    joined = per_product.join(brand_lookup(brands, order_by), "Asin", "left")
    first = F.col("direct").isNotNull()
    second = ~first & F.col("parent").isNotNull()

    def reviews_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counts = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        reviews_where(first | second).alias("matched"),
        reviews_where(first).alias("first_round"),
        reviews_where(second).alias("second_round"),
    )
    return counts.withColumn("match_rate", percent(F.col("matched"), F.col("total"), 1))

"""Table profiles and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvoice.functions.numbers import percent
from shelfvoice.functions.text import preview_text
from shelfvoice.schema import NOT_ENRICHABLE, SAMPLE_PREVIEW_CHARS
from shelfvoice.sources.writers import text_columns


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, present and missing values of each column, from one scan."""
    present = [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *present)
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_present"))
            for i, c in enumerate(columns)
        ]
    )
    return counts.select(F.col("n").alias("n_rows"), F.explode(rows).alias("r")).select(
        "r.column_name",
        "n_rows",
        "r.n_present",
        (F.col("n_rows") - F.col("r.n_present")).alias("n_missing"),
        percent(F.col("r.n_present"), F.col("n_rows"), 1).alias("pct_present"),
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    """Size of a table, its text columns and how many reviews carry text."""
    texts = [F.count(c) for c in ("Title", "Content") if c in df.columns]
    n_texts = F.greatest(*texts) if len(texts) == 2 else F.lit(None).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(len(text_columns(df, []))).cast("bigint").alias("n_text_columns"),
        F.lit(",".join(text_columns(df, NOT_ENRICHABLE))).alias("enrichable"),
        n_texts.alias("n_texts"),
    ).withColumn("is_empty", F.col("n_rows") == 0)


def preview(df: DataFrame, n: int = 10, order_by: str = "ID") -> DataFrame:
    """First rows of a table."""
    return df.orderBy(order_by).limit(n)


def sample_values(df: DataFrame, column: str, n: int = 3, order_by: str = "ID") -> DataFrame:
    """First values of a column that are not missing, cut for display."""
    first = df.filter(F.col(f"`{column}`").isNotNull()).orderBy(order_by).limit(n)
    return first.select(order_by, preview_text(F.col(f"`{column}`"), SAMPLE_PREVIEW_CHARS).alias("preview"))

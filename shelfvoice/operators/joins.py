"""Lookup joins against a table with one row per key.

The looked-up table is broadcast only after its size was measured. Beyond the
bound the join shuffles, and keys that hold many rows are salted, so that one
product or one copied text cannot fill a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfvoice.sources.workspace import stage

BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame) -> bool:
    """Measure the small side: rows first, bytes only if the rows fit.

    Rows of a table come from its footers, so a large table is not read.
    """
    if df.count() > BROADCAST_MAX_ROWS:
        return False
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_MAX_BYTES


def _pieces(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, key: str, pieces: int) -> DataFrame:
    """Keys with more rows than an average partition, and their number of salts.

    Fewer than ``pieces`` keys can qualify, so the result is always small.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    hot = counts.filter(F.col("_n") * pieces > total)
    return hot.select(key, F.ceil(F.col("_n") * pieces / total).cast("int").alias("_salts"))


def salted_left(left: DataFrame, right: DataFrame, key: str, spread_by: Column) -> DataFrame:
    """Left join that splits hot keys; ``right`` has one row per key.

    ``spread_by`` must be a function of the row alone (an id), so that a task
    that runs again sends every row to the same place.
    """
    pieces = _pieces(left)
    # Staged, so that both sides read the short list and count nothing again.
    hot = F.broadcast(stage(hot_keys(left, key, pieces), "hot-keys"))
    spread = F.xxhash64(spread_by)
    salted = left.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), F.pmod(spread, F.lit(pieces)))
        .when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")))
        .otherwise(F.lit(0).cast("bigint")),
    )
    copies = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.coalesce("_salts", F.lit(1)) - 1).cast("bigint")))
    )
    return salted.drop("_salts").join(copies.drop("_salts"), [key, "_salt"], "left").drop("_salt")


def salted_inner(left: DataFrame, right: DataFrame, key: str, spread_by: Column) -> DataFrame:
    """Inner join that splits hot keys of ``left``; ``right`` may have several rows for a key."""
    hot = F.broadcast(stage(hot_keys(left, key, _pieces(left)), "hot-keys"))
    salts = F.coalesce("_salts", F.lit(1)).cast("bigint")
    salted = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts)).drop("_salts")
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_salts")
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def lookup_left(
    left: DataFrame, right: DataFrame, key: str, spread_by: Column, size_of: DataFrame | None = None
) -> DataFrame:
    """Left join to a keyed table: broadcast if measured small, else salted.

    ``size_of`` may name a cheaper frame whose size bounds that of ``right``.
    """
    if fits_broadcast(right if size_of is None else size_of):
        return left.join(F.broadcast(right), key, "left")
    return salted_left(left, right, key, spread_by)

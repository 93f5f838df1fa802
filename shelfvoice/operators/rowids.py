"""Dense 1-based row ids without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfvoice.operators.joins import lookup_left
from shelfvoice.sources.readers import FILE_COLUMN, ROW_COLUMN, SPLIT_COLUMN
from shelfvoice.sources.workspace import stage

_SLOT_BITS = 33


def _running_start(sizes: DataFrame, *order: str) -> DataFrame:
    """Rows before each part. ``sizes`` has one row per partition."""
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _split_starts(sizes: DataFrame) -> DataFrame:
    """Rows before each split ``_at``, in two levels.

    Splits are dealt over ranges and written with the number of their range.
    Offsets inside a range are summed by range, those of the ranges, at most one
    for each shuffle partition, in one short window. No task sees all splits.
    """
    dealt = stage(sizes.repartitionByRange("_at").withColumn("_range", F.spark_partition_id()), "split-sizes")
    ranges = _running_start(dealt.groupBy("_range").agg(F.sum("_n").alias("_n")), "_range")
    inside = W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    return (
        dealt.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(F.broadcast(ranges.drop("_n")), "_range")
        .select("_at", (F.col("_before") + F.col("_inside") - F.col("_first")).alias("_shift"))
    )


def ids_in_file_order(df: DataFrame, id_col: str = "ID") -> DataFrame:
    """Ids in input order for an unfiltered file scan with its position columns.

    A row's id is its place in its split plus the rows of the splits before it,
    so the rows themselves are neither shuffled nor sorted. Splits are counted
    in a scan of their own that reads no data columns. Their offsets are
    broadcast if measured small; beyond, they are joined by split, and splits
    with many rows are salted by row.
    """
    placed = df.withColumn("_at", F.struct(FILE_COLUMN, SPLIT_COLUMN))
    starts = _split_starts(placed.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), F.min(ROW_COLUMN).alias("_first")))
    shifted = lookup_left(placed, starts, "_at", F.col(ROW_COLUMN))
    return shifted.withColumn(id_col, F.col("_shift") + F.col(ROW_COLUMN) + 1).drop("_shift", "_at")


def assign_row_ids(
    df: DataFrame, order_by: list[str | Column], id_col: str = "ID", keep: list[str] | None = None
) -> DataFrame:
    """Ids in the order of ``order_by``, equal to a global ``row_number``.

    ``keep`` names the columns of the result (default all), so that columns only
    needed for the order are not written.

    Range partitions are sorted and written once; the id is the place inside the
    partition plus the rows of the partitions before it. Rows that tie are
    ordered by a hash of the whole row, and equal rows by their place in the
    input, so that large groups of ties or of equal rows are split.
    """
    kept = [F.col(f"`{c}`") for c in keep or df.columns]
    placed = df.withColumns({"_tie": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), "_place_in": F.monotonically_increasing_id()})
    keys = [*order_by, "_tie", "_place_in"]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(ordered.select(*kept, F.monotonically_increasing_id().alias("_slot")), "row-ids")
    part = F.shiftright("_slot", _SLOT_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = _running_start(sizes, "_part").select("_part", "_before")
    offset = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    # One row per partition: broadcast size is the number of shuffle partitions.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select((F.col("_before") + offset + 1).alias(id_col), *kept)
    )

"""Rows by position in an order, without sorting the whole table.

Positions are found by selection: bounds around them are taken from a sample of
the keys, the rows before and between the bounds are counted exactly, and this
repeats inside the slice until it is little larger than the rows asked for. Only
that slice is sorted and written.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvoice.operators.rowids import assign_row_ids

#: Keys sampled for one pair of bounds; the driver gets two of them. A sample may be sorted by one task.
SAMPLE_KEYS = 50_000
#: A slice is small enough at twice the rows asked for and this many more.
SLACK_ROWS = 4_096
#: Distance of the bounds from the wanted places of a sample, in standard deviations. A miss costs one more round.
MARGIN = 4.0
_TIE = "_tie"


@dataclass(frozen=True)
class Key:
    """One column of an order. A missing value is the least, as in Spark's own sort orders."""

    name: str
    ascending: bool = True

    def sort(self) -> Column:
        return F.col(f"`{self.name}`").asc() if self.ascending else F.col(f"`{self.name}`").desc()


@dataclass(frozen=True)
class Slice:
    """Rows from ``low`` to before ``high`` in an order (``None``: no bound), ``before`` rows preceding them."""

    keys: tuple[Key, ...]
    low: tuple[Column, ...] | None
    high: tuple[Column, ...] | None
    before: int
    rows: int
    hashed: tuple[str, ...] = ()

    def of(self, df: DataFrame) -> DataFrame:
        """The slice's rows of a table that holds the key columns (and, where ties are cut, the hashed ones)."""
        tests = [] if self.low is None else [~self._precedes(self.low)]
        tests += [] if self.high is None else [self._precedes(self.high)]
        return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df

    def _precedes(self, bound: tuple[Column, ...]) -> Column:
        """Whether a row comes before the bound, as a predicate that reaches the scan."""
        test = F.lit(False)
        for key, value in reversed(list(zip(self.keys, bound))):
            column = F.xxhash64(*[F.col(f"`{c}`") for c in self.hashed]) if key.name == _TIE else F.col(f"`{key.name}`")
            if key.ascending:
                less = F.lit(False) if value is None else column.isNull() | (column < value)
            else:
                less = column.isNotNull() if value is None else column.isNotNull() & (column > value)
            same = column.isNull() if value is None else column.isNotNull() & (column == value)
            test = less | (same & test)
        return test


def _portable(name: str, kind: T.DataType) -> Column:
    """A value in a form that comes back from the driver unchanged: no time zone, no rounding."""
    column = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    return column if isinstance(kind, T.BinaryType) else column.cast("string")


def _literal(value, kind: T.DataType) -> Column | None:
    if value is None:
        return None
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value) if isinstance(kind, T.BinaryType) else F.lit(value).cast(kind)


def _sampled_bounds(keys: DataFrame, order: tuple[Key, ...], first: int, last: int, rows: int):
    """Keys of a sample that probably lie just before place ``first`` and just after place ``last`` of ``rows``."""
    share = min(1.0, SAMPLE_KEYS / rows)
    sample = keys if share == 1.0 else keys.sample(share, seed=rows % 1_000_003)
    # Which sampled key has a given place is binomial; a whole table as its own sample is exact.
    low_spread, high_spread = [MARGIN * sqrt(p * share * (1 - share)) + 2 * (share < 1) for p in (first, last)]
    low, high = floor(first * share - low_spread), ceil(last * share + high_spread) + 1
    # One task sorts about SAMPLE_KEYS keys.
    placed = sample.withColumn("_place", F.row_number().over(W.orderBy(*[k.sort() for k in order])) - 1)
    kinds = [keys.schema[k.name].dataType for k in order]
    picked = placed.filter(F.col("_place").isin(low, high)).select(
        "_place", *[_portable(k.name, t).alias(f"k{i}") for i, (k, t) in enumerate(zip(order, kinds))]
    )
    found = {r[0]: tuple(_literal(v, t) for v, t in zip(r[1:], kinds)) for r in picked.collect()}
    return found.get(low), found.get(high)


def _narrowed(df: DataFrame, part: Slice, first: int, last: int) -> Slice:
    """A slice inside ``part`` that still holds the places from ``first`` to before ``last``, by exact counts."""
    tie = [F.xxhash64(*[F.col(f"`{c}`") for c in part.hashed]).alias(_TIE)] if part.hashed else []
    names = [F.col(f"`{k.name}`") for k in part.keys if k.name != _TIE]
    keys = part.of(df).select(*names, *tie)
    low, high = _sampled_bounds(keys, part.keys, first - part.before, last - part.before - 1, part.rows)
    inner = Slice(part.keys, low, high, 0, 0, part.hashed)
    early = F.lit(False) if low is None else inner._precedes(low)
    within = ~early & (F.lit(True) if high is None else inner._precedes(high))
    n_early, n_within = part.of(df).agg(F.count_if(early), F.count_if(within)).first()
    if low is None or part.before + n_early > first:
        low, n_early, n_within = part.low, 0, n_early + n_within
    if high is None or part.before + n_early + n_within < last:
        high, n_within = part.high, part.rows - n_early
    return Slice(part.keys, low, high, part.before + n_early, n_within, part.hashed)


def find_slice(df: DataFrame, order: list[Key], start: int, end: int, hashed: list[str] | None = None) -> Slice | None:
    """A slice little larger than the rows ``[start, end)``; ``None`` if there are no such rows.

    ``df`` needs the key columns only, unless ``hashed`` names the columns whose
    hash orders ties: they are read once ties make a slice too large. The rows
    must be the same at each read. Every round reads the keys of the last slice
    twice and leaves a few hundredths of it, so rounds grow with the logarithm
    of the table. A slice that stays large holds equal keys only, beside the range.
    """
    n = df.count()
    start, end = max(start, 0), min(end, n)
    if start >= end:
        return None
    part = Slice(tuple(order), None, None, 0, n)
    enough = 2 * (end - start) + SLACK_ROWS
    while part.rows > enough:
        inner = _narrowed(df, part, start, end)
        if inner.rows > part.rows * 3 // 4:
            if hashed is None or part.hashed:
                return inner
            # Ties: the hash of the row becomes the last key. Bounds without it precede all of their ties.
            inner = _with_tie(inner, hashed)
        part = inner
    return part


def _with_tie(part: Slice, hashed: list[str]) -> Slice:
    least = F.lit(-(1 << 63)).cast("long")
    low, high = [None if b is None else (*b, least) for b in (part.low, part.high)]
    return Slice((*part.keys, Key(_TIE)), low, high, part.before, part.rows, tuple(hashed))


def rows_between(df: DataFrame, order: list[Key], start: int, end: int) -> DataFrame:
    """Rows ``[start, end)`` of the table in ``order``; ties are ordered by a hash of the whole row.

    A start below 0 counts as 0, an end beyond the table as its end; nothing
    between them, or an empty table, gives no rows. Keys of nested types have no
    literal to bound them, so for those all rows are numbered.
    """
    sorts = [k.sort() for k in order]
    if any(isinstance(df.schema[k.name].dataType, (T.ArrayType, T.StructType, T.VariantType)) for k in order):
        return _cut(assign_row_ids(df, sorts, "_position"), start, end)
    part = find_slice(df, order, start, end, df.columns)
    if part is None:
        return df.limit(0)
    return _cut(assign_row_ids(part.of(df), sorts, "_position"), start - part.before, end - part.before)


def _cut(numbered: DataFrame, start: int, end: int) -> DataFrame:
    return numbered.filter((F.col("_position") > start) & (F.col("_position") <= end)).drop("_position")

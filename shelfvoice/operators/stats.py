"""Rating statistics: overview, groups, cross-tabs, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfvoice.functions.numbers import half_even, month_bucket, percent
from shelfvoice.functions.text import group_key
from shelfvoice.schema import HIGH_RATING, LOW_RATING, RATING_SCALE, REVIEW_TYPE, REVIEW_TYPES


def _is_type(t: str) -> Column:
    return F.col(f"`{REVIEW_TYPE}`") == t


def _group(by: str | list[str]) -> Column:
    names = [by] if isinstance(by, str) else list(by)
    return group_key(*[F.col(f"`{n}`") for n in names])


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_reviews"),
        half_even(F.avg("Rating")).alias("avg_rating"),
        F.count_if(_is_type("positive")).alias("n_positive"),
        F.count_if(_is_type("negative")).alias("n_negative"),
    )


def span_overview(df: DataFrame) -> DataFrame:
    """Distinct products and the first and last month."""
    return df.agg(
        F.count_distinct("Asin").alias("n_products"),
        month_bucket(F.min("Date")).alias("first_month"),
        month_bucket(F.max("Date")).alias("last_month"),
    )


def rating_thresholds(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count_if(F.col("Rating") >= HIGH_RATING).alias("n_high"),
        F.count_if(F.col("Rating") <= LOW_RATING).alias("n_low"),
        half_even(F.avg("Rating")).alias("avg_rating"),
    )


def review_type_stats(df: DataFrame) -> DataFrame:
    """Count and share by type; untyped reviews count in the denominator only."""
    counts = df.groupBy(F.col(f"`{REVIEW_TYPE}`").alias("review_type")).agg(F.count(F.lit(1)).alias("n_reviews"))
    # At most one row per type reaches this window.
    total = F.sum("n_reviews").over(W.partitionBy())
    return counts.withColumn("pct", percent(F.col("n_reviews"), total)).filter("review_type IS NOT NULL")


def dense_types(df: DataFrame) -> DataFrame:
    """Count for each known type in fixed order, zero when absent."""
    counts = df.agg(*[F.count_if(_is_type(t)).alias(t) for t in REVIEW_TYPES])
    rows = F.array(*[F.struct(F.lit(t).alias("review_type"), F.col(t).alias("n_reviews")) for t in REVIEW_TYPES])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def rating_histogram(df: DataFrame) -> DataFrame:
    return (
        df.filter("Rating IS NOT NULL").groupBy("Rating").agg(F.count(F.lit(1)).alias("n_reviews")).orderBy("Rating")
    )


def _rating_measures() -> list[Column]:
    return [
        F.count("Rating").alias("n_reviews"),
        half_even(F.avg("Rating")).alias("avg_rating"),
        half_even(F.stddev_samp("Rating")).alias("std_rating"),
    ]


def _type_map() -> Column:
    """Counts by type as a map without zeros; three counters, no list is built."""
    pairs = [x for t in REVIEW_TYPES for x in (F.lit(t), F.count_if(_is_type(t)))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def _keyed(df: DataFrame, by: str | list[str]) -> DataFrame:
    """Rows that have all parts of the key, tested before the key is built."""
    return df.dropna(subset=[by] if isinstance(by, str) else list(by))


def group_stats(df: DataFrame, by: str | list[str], with_types: bool = False) -> DataFrame:
    """Count, mean and deviation per group, optionally with the type distribution.

    A list of columns gives the key ``A - B``; rows lacking a part are left out.
    """
    measures = _rating_measures() + ([_type_map().alias("type_dist")] if with_types else [])
    return _keyed(df, by).groupBy(_group(by).alias("grp")).agg(*measures)


def group_type_map(df: DataFrame, by: str | list[str]) -> DataFrame:
    return _keyed(df, by).groupBy(_group(by).alias("grp")).agg(_type_map().alias("type_dist"))


def group_stats_multikey(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same measures on the raw key columns."""
    return df.dropna(subset=keys).groupBy(*keys).agg(*_rating_measures())


def _rated(df: DataFrame, by: str | list[str]) -> DataFrame:
    return df.select(_group(by).alias("grp"), "Rating").dropna()


def rating_crosstab(df: DataFrame, by: str | list[str]) -> DataFrame:
    """Share of each rating in its group, one row per group and rating."""
    counts = _rated(df, by).groupBy("grp", "Rating").agg(F.count(F.lit(1)).alias("n_reviews"))
    # Rows are counts by now: a group has one per rating value.
    in_group = F.sum("n_reviews").over(W.partitionBy("grp"))
    return counts.withColumn("pct", percent(F.col("n_reviews"), in_group, None))


def rating_crosstab_wide(df: DataFrame, by: str | list[str], ratings: list[float] = RATING_SCALE) -> DataFrame:
    """One row per group with a share column for each named rating, and ``rating_other`` for all others."""
    is_named = F.col("Rating").isin([float(r) for r in ratings])
    names = [f"rating_{r:g}".replace(".", "_") for r in ratings]
    counts = (
        _rated(df, by)
        .groupBy("grp")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.count_if(F.col("Rating") == r).alias(n) for n, r in zip(names, ratings)],
            F.count_if(~is_named).alias("rating_other"),
        )
    )
    return counts.select("grp", *[percent(F.col(n), F.col("_n"), None).alias(n) for n in [*names, "rating_other"]])


def group_levels(df: DataFrame, levels: list[list[str]], ratings: list[float] = RATING_SCALE) -> DataFrame:
    """``group_stats`` with types and ``rating_crosstab_wide`` of several levels from one scan.

    A level is a list of columns. The result has a row for each ``(level, grp)``:
    the measures, a counter for each type, and the shares of the ratings (NULL
    in a group without a rating). As in ``group_stats``, rows that lack a part
    of a level's key are left out of that level only. Rows are expanded once a
    level inside the tasks and summed there before they shuffle.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    # The id has a bit for each column, the first one highest, set where the level leaves the column out.
    ids = [sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in level) for level in levels]
    names = [f"rating_{r:g}".replace(".", "_") for r in ratings]
    is_named = F.col("Rating").isin([float(r) for r in ratings])
    counts = df.groupingSets([[F.col(f"`{c}`") for c in level] for level in levels], *[F.col(f"`{c}`") for c in columns]).agg(
        F.grouping_id().alias("_level"),
        *_rating_measures(),
        *[F.count_if(_is_type(t)).alias(f"n_{t}") for t in REVIEW_TYPES],
        *[F.count_if(F.col("Rating") == r).alias(n) for n, r in zip(names, ratings)],
        F.count_if(~is_named).alias("rating_other"),
    )
    is_level = [F.col("_level") == k for k in ids]
    whole, key, name = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, level in zip(is_level, levels):
        present = [F.col(f"`{c}`").isNotNull() for c in level]
        whole = F.when(test, reduce(lambda a, b: a & b, present)).otherwise(whole)
        key = F.when(test, _group(level)).otherwise(key)
        name = F.when(test, F.lit(" - ".join(level))).otherwise(name)
    shares = [percent(F.col(n), F.col("n_reviews"), None).alias(n) for n in [*names, "rating_other"]]
    measures = ["n_reviews", "avg_rating", "std_rating", *[f"n_{t}" for t in REVIEW_TYPES]]
    return counts.filter(whole).select(name.alias("level"), key.alias("grp"), *measures, *shares)


def rating_shares(df: DataFrame, by: str | list[str], group: str | None = None) -> DataFrame:
    """Shares above zero by group, high ratings first; one group if named."""
    wanted = df if group is None else df.filter(_group(by) == group)
    return rating_crosstab(wanted, by).filter("pct > 0").orderBy("grp", F.desc("Rating"))


def rating_trend(df: DataFrame, by: str | None = None) -> DataFrame:
    """Mean rating by month, overall or by one column; undated reviews are left out."""
    keys = [] if by is None else [F.col(f"`{by}`").alias("grp")]
    dated = df.filter("Date IS NOT NULL") if by is None else df.dropna(subset=["Date", by])
    # Months are grouped as dates and written out once a group.
    means = dated.groupBy(F.trunc("Date", "month").alias("_month"), *keys).agg(F.avg("Rating").alias("avg_rating"))
    return means.select(month_bucket(F.col("_month")).alias("month"), *(["grp"] if keys else []), "avg_rating")

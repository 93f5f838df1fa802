"""Keyword lexicon: upkeep, tagging of reviews and match statistics.

A lexicon is a table ``(main, sub, keyword)`` kept by hand. Matching is literal,
ignores case and also finds a keyword inside a longer word. Each text is scanned
once and yields the array of keywords it holds; nothing pairs every text with
every keyword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfvoice.functions.numbers import half_even, percent
from shelfvoice.functions.text import trim_text
from shelfvoice.schema import CATEGORIES_SHOWN, KEYWORDS_SHOWN, REVIEW_TYPE, TRANSLATED_NAMES
from shelfvoice.sources.readers import literal_table

# A lexicon is kept by hand; one beyond this is refused, since its keywords are part of the plan.
MAX_KEYWORDS = 100_000

# ---------------------------------------------------------------- upkeep


def lexicon_from_spec(spark: SparkSession, spec: dict[str, dict[str, str]]) -> DataFrame:
    """Nested ``{main: {sub: "kw,kw"}}`` as ``(main, sub, keywords)``."""
    rows = [(main, sub, kws) for main, subs in spec.items() for sub, kws in subs.items()]
    return literal_table(spark, rows, ["main", "sub", "keywords"])


def normalise_lexicon(raw: DataFrame) -> DataFrame:
    """``(main, sub, keyword)``: split at commas and lines, trimmed, no blanks or repeats."""
    parts = raw.select("main", "sub", F.explode(F.split("keywords", "[,\n]")).alias("k"))
    return parts.select("main", "sub", trim_text(F.col("k")).alias("keyword")).filter("keyword <> ''").distinct()


def upsert_categories(lexicon: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the categories that ``changes`` names, add the new ones."""
    return delete_categories(lexicon, changes).unionByName(changes.select(lexicon.columns))


def delete_categories(lexicon: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop ``(main, sub)`` categories, or whole main categories if only ``main`` is given."""
    keys = [c for c in ("main", "sub") if c in removed.columns]
    return lexicon.join(removed.select(*keys).distinct(), keys, "left_anti")


def upgrade_flat(flat: DataFrame, preset: DataFrame, default_main: str) -> DataFrame:
    """Flat ``(sub, keywords)`` rows get the main category of a preset ``(sub, main)``."""
    known = preset.select("sub", F.col("main").alias("_main")).groupBy("sub").agg(F.min("_main").alias("_main"))
    placed = flat.select("sub", "keywords").join(known, "sub", "left")
    return placed.select(F.coalesce("_main", F.lit(default_main)).alias("main"), "sub", "keywords")


# -------------------------------------------------------------- matching


@dataclass(frozen=True)
class Lexicon:
    """A lexicon on the driver, where its categories become columns."""

    entries: tuple[tuple[str, str, str], ...]

    @staticmethod
    def of(table: DataFrame) -> Lexicon:
        """Read a normalised lexicon table; more than ``MAX_KEYWORDS`` rows are refused, none is dropped."""
        rows = table.select("main", "sub", "keyword").limit(MAX_KEYWORDS + 1).collect()
        if len(rows) > MAX_KEYWORDS:
            raise ValueError(f"a lexicon of more than {MAX_KEYWORDS} rows is not kept by hand")
        return Lexicon(tuple(sorted({(r.main, r.sub, r.keyword) for r in rows})))

    @property
    def keywords(self) -> list[str]:
        return sorted({k for _, _, k in self.entries})

    @property
    def categories(self) -> list[tuple[str, str]]:
        return sorted({(m, s) for m, s, _ in self.entries})

    def keywords_of(self, category: tuple[str, str]) -> list[str]:
        return [k for m, s, k in self.entries if (m, s) == category]


def flag_name(main: str, sub: str) -> str:
    return f"is_{re.sub(r'[ .`]', '_', main)}__{re.sub(r'[ .`]', '_', sub)}"


def flag_names(categories: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """Public column of each category, unique also where case does not count; clashes get a running number."""
    names: dict[tuple[str, str], str] = {}
    taken: set[str] = set()
    for category in categories:
        plain = name = flag_name(*category)
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{plain}_{n}"
        taken.add(name.lower())
        names[category] = name
    return names


def _usable(keywords: list[str]) -> list[str]:
    """Distinct keywords in order; blank ones match nothing, as in a normalised lexicon."""
    return sorted({k for k in keywords if k.strip()})


def _lowered(keywords: list[str]) -> Column:
    """Constant array of ``(k, low)``; Spark folds the case on both sides."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lower(F.lit(k)).alias("low")) for k in keywords])


def _any_keyword(lower_text: Column, keywords: list[str]) -> Column:
    usable = _usable(keywords)
    if not usable:
        return F.lit(False)
    return F.coalesce(F.exists(_lowered(usable), lambda x: F.contains(lower_text, x["low"])), F.lit(False))


def _held_keywords(lower_text: Column, keywords: list[str]) -> Column:
    """Sorted keywords that a text holds; one expression for a lexicon of any size."""
    usable = _usable(keywords)
    if not usable:
        return F.array().cast("array<string>")
    held = F.filter(_lowered(usable), lambda x: F.coalesce(F.contains(lower_text, x["low"]), F.lit(False)))
    return F.transform(held, lambda x: x["k"])


def add_matches(df: DataFrame, keywords: list[str], column: str = "Content", out: str = "Matches") -> DataFrame:
    """Add the sorted array of keywords each text holds; missing text holds none."""
    low = df.withColumn("_low", F.lower(F.col(column)))
    return low.withColumn(out, _held_keywords(F.col("_low"), keywords)).drop("_low")


def match_array(df: DataFrame, keywords: list[str], column: str = "Content") -> DataFrame:
    """Add ``Matches`` and ``Match_Count``."""
    return add_matches(df, keywords, column).withColumn("Match_Count", F.size("Matches").cast("bigint"))


def matched_only(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("Match_Count") > 0)


def add_flags(df: DataFrame, lexicon: Lexicon, column: str = "Content") -> DataFrame:
    """Add one boolean column per category to the rows themselves, named by :func:`flag_names`."""
    low = df.withColumn("_low", F.lower(F.col(column)))
    names = flag_names(lexicon.categories)
    clash = {n.lower() for n in names.values()} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the table has columns with the names of flags: {sorted(clash)}")
    return low.withColumns({names[c]: _any_keyword(F.col("_low"), lexicon.keywords_of(c)) for c in lexicon.categories}).drop("_low")


def tag_projection(df: DataFrame) -> DataFrame:
    """Columns a tagged result keeps: id, text, type and the first translation found."""
    translated = [c for c in TRANSLATED_NAMES if c in df.columns][:1]
    return df.select("ID", "Content", F.col(f"`{REVIEW_TYPE}`").alias("Original Review Type"), *translated)


def category_flags(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    return add_flags(tag_projection(df), lexicon)


def flag_filter(flagged: DataFrame, main: str, sub: str, lexicon: Lexicon | None = None) -> DataFrame:
    """Rows of one category; name the lexicon where names of categories clash."""
    name = flag_names(lexicon.categories)[main, sub] if lexicon else flag_name(main, sub)
    return flagged.filter(F.col(f"`{name}`"))


def _each_keyword(df: DataFrame, keywords: list[str], column: str, *carried: str) -> DataFrame:
    """One row per text and keyword held, with the carried columns.

    The array is built inside ``explode``: exploding it as a column would make
    Catalyst filter on its size first, which matches every text twice.
    """
    low = df.select(*carried, F.lower(F.col(column)).alias("_low"))
    return low.select(*carried, F.explode(_held_keywords(F.col("_low"), keywords)).alias("keyword"))


def lexicon_join(df: DataFrame, lexicon: Lexicon, column: str = "Content", id_col: str = "ID") -> DataFrame:
    """One row per review, category and keyword held."""
    pairs = _each_keyword(df, lexicon.keywords, column, id_col)
    return pairs.join(F.broadcast(lexicon_table(df.sparkSession, lexicon)), "keyword").select(
        id_col, "main", "sub", "keyword"
    )


def lexicon_table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    return literal_table(spark, list(lexicon.entries), ["main", "sub", "keyword"])


# ------------------------------------------------------------ statistics


def category_stats(df: DataFrame, lexicon: Lexicon, column: str = "Content") -> DataFrame:
    """Matched and unmatched reviews of each category, zero rows included.

    One aggregation over the flags; only one row of counters leaves each task.
    """
    categories = lexicon.categories
    low = df.select(F.lower(F.col(column)).alias("_low"))
    counts = low.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(_any_keyword(F.col("_low"), lexicon.keywords_of(c))).alias(f"_c{i}") for i, c in enumerate(categories)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("main"), F.lit(s).alias("sub"), F.col(f"_c{i}").alias("matched"))
            for i, (m, s) in enumerate(categories)
        ]
    )
    typed = rows.cast("array<struct<main:string,sub:string,matched:bigint>>")
    return counts.select("_n", F.explode(typed).alias("r")).select(
        "r.main",
        "r.sub",
        "r.matched",
        percent(F.col("r.matched"), F.col("_n")).alias("pct"),
        (F.col("_n") - F.col("r.matched")).alias("unmatched"),
    )


def keyword_counts(df: DataFrame, keywords: list[str], column: str = "Content") -> DataFrame:
    """Reviews that hold each keyword; keywords held by none are absent."""
    return _each_keyword(df, keywords, column).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


def keyword_frequency(df: DataFrame, lexicon: Lexicon, column: str = "Content") -> DataFrame:
    """Reviews per category and keyword, frequent keywords first."""
    counts = keyword_counts(df, lexicon.keywords, column)
    # At most one count per keyword is left to join.
    table = F.broadcast(lexicon_table(df.sparkSession, lexicon))
    return (
        counts.join(table, "keyword")
        .select("main", "sub", "keyword", "n")
        .orderBy("main", "sub", F.desc("n"), "keyword")
    )


def top_keywords(frequency: DataFrame, n: int = KEYWORDS_SHOWN) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("main", "sub").orderBy(F.desc("n"), "keyword"))
    return frequency.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def category_ranking(stats: DataFrame, by: str = "pct", descending: bool = True) -> DataFrame:
    """Categories by ``pct``, ``matched`` or ``name`` in either direction, with their ``rank``."""
    keys = ["main", "sub"] if by == "name" else [by]
    order = [F.desc(k) if descending else F.asc(k) for k in keys]
    # One row a category: a lexicon's size.
    return stats.withColumn("rank", F.row_number().over(W.orderBy(*order, "main", "sub")).cast("bigint")).orderBy("rank")


def top_categories(stats: DataFrame, n: int = CATEGORIES_SHOWN) -> DataFrame:
    return stats.orderBy(F.desc("pct"), "main", "sub").limit(n)


def match_summary(matched: DataFrame) -> DataFrame:
    counts = matched.agg(
        F.count(F.lit(1)).alias("total_reviews"), F.count_if(F.col("Match_Count") > 0).alias("matched_reviews")
    )
    return counts.withColumn("match_rate", percent(F.col("matched_reviews"), F.col("total_reviews"), None))


def match_by_rating(matched: DataFrame) -> DataFrame:
    """Matched reviews of each rating and the mean number of keywords they hold.

    Unmatched reviews are left out by the aggregates, not by a filter, which
    would be pushed below the matching and repeat it.
    """
    counts = matched.groupBy("Rating").agg(
        F.count_if(F.col("Match_Count") > 0).alias("n_reviews"), F.sum("Match_Count").alias("_n")
    )
    return counts.filter("Rating IS NOT NULL AND n_reviews > 0").select(
        "Rating", "n_reviews", half_even(F.col("_n") / F.col("n_reviews")).alias("avg_matches")
    )


def match_keyword_counts(matched: DataFrame) -> DataFrame:
    """Reviews by keyword over the matched arrays."""
    each = matched.select(F.explode(F.array_compact("Matches")).alias("keyword"))
    return each.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


def match_rating_counts(matched: DataFrame) -> DataFrame:
    return match_by_rating(matched).select("Rating", "n_reviews")

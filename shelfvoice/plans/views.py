"""Review-shaped views over the star-schema and document tables.

They give the registered queries their inputs. ``plans.oracle`` states the same
views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfvoice.functions.numbers import rating_bucket
from shelfvoice.operators.brands import join_brands
from shelfvoice.operators.lexicon import normalise_lexicon
from shelfvoice.schema import REVIEW_TYPE
from shelfvoice.sources.readers import POSITION_COLUMNS, literal_table, spread_small, with_position

LINE_ORDER = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_shipdate",
]
STOP_WORDS = ["the", "and", "der", "that", "don't"]
LEXICON_ROWS = [
    ("topic", "thing", "thing, heed , ,thing"),
    ("topic", "notice", "license,@"),
    ("lang", "german", "und"),
    ("lang", "french", "que la"),
    ("lang", "none", "zzqx"),
]
SYLLABLES = [(v, c, c + v + d) for c in "lmnrst" for v in "aeiou" for d in "lmnrst"]
MATCH_KEYWORDS = ["thing", "heed", "license", "@", "und", "que la", "zzqx"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_reviews_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as raw text reviews, some with a bad rating or date."""
    li = spread_small(table(spark, sf, "lineitem"))
    rating = F.ceil(F.col("l_quantity") / 10).cast("int").cast("string")
    return li.select(
        F.concat(F.lit(" A"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("Asin"),
        F.concat(F.lit("\u00a0line "), F.col("l_linenumber").cast("string"), F.lit("\t")).alias("Title"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" \n")).alias("Content"),
        F.concat(F.lit("  "), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" ")).alias("Model"),
        F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(rating).alias("Rating"),
        F.when(F.col("l_linenumber") == 6, F.lit("unknown"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("Date"),
        *LINE_ORDER,
    )


def order_reviews_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw reviews in file order."""
    orders = with_position(table(spark, sf, "orders"), "parquet")
    return orders.select(
        F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("Asin"),
        F.col("o_orderpriority").alias("Title"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("Content"),
        F.col("o_orderstatus").alias("Model"),
        F.ceil(F.col("o_totalprice") / 100000).cast("string").alias("Rating"),
        F.date_format("o_orderdate", "yyyy/M/d").alias("Date"),
        *POSITION_COLUMNS,
    )


def line_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as typed reviews."""
    li = table(spark, sf, "lineitem")
    rating = F.ceil(F.col("l_quantity") / 10).cast("double")
    return li.select(
        F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("Asin"),
        F.concat("l_returnflag", "l_linestatus").alias("Model"),
        rating.alias("Rating"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("Date"),
        rating_bucket(rating).alias(REVIEW_TYPE),
        *LINE_ORDER,
    )


def brands(spark: SparkSession, sf: str) -> DataFrame:
    """All parts: every third has a brand, which its successor inherits as parent; the others' is missing or blank."""
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("A"), key.cast("string"), F.lit(" ")).alias("ASIN"),
        F.when(key % 3 == 0, F.col("p_brand")).when(key % 3 == 2, F.lit("  ")).alias("Brand"),
        F.concat(F.lit("A"), (key + 1).cast("string")).alias("Parent ASIN"),
        key.alias("ord"),
    )


def brands_with_stale(spark: SparkSession, sf: str) -> DataFrame:
    """The brand table with an older row for each product."""
    now = brands(spark, sf)
    old = now.withColumns({"Brand": F.lit("stale"), "ord": F.lit(-1).cast("bigint")})
    return old.unionByName(now)


def branded_reviews(spark: SparkSession, sf: str) -> DataFrame:
    reviews = line_reviews(spark, sf)
    return join_brands(reviews, brands(spark, sf), ["ord"], F.struct(*LINE_ORDER))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as bare review texts, for what needs neither rating nor date."""
    return spread_small(table(spark, sf, "documents").select(F.col("doc_id").alias("ID"), F.col("text").alias("Content")))


def text_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as reviews; many have no rating, some no date."""
    docs, labels = spread_small(table(spark, sf, "documents")), table(spark, sf, "labels")
    rating = (
        F.when(F.col("quality").isNull(), None)
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), 5.0)
        .when(F.col("quality") == 1, 3.0)
        .otherwise(1.0)
        .cast("double")
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ID"),
        F.col("source").alias("Asin"),
        F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("Title"),
        F.col("lang").alias("Model"),
        F.col("text").alias("Content"),
        rating.alias("Rating"),
        F.when(F.col("doc_id") % 50 != 7, day).cast("timestamp_ntz").alias("Date"),
        rating_bucket(rating).alias(REVIEW_TYPE),
    )


def lexicon_raw(spark: SparkSession) -> DataFrame:
    return literal_table(spark, LEXICON_ROWS, ["main", "sub", "keywords"])


def lexicon(spark: SparkSession) -> DataFrame:
    return normalise_lexicon(lexicon_raw(spark))


def part_lexicon_raw(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon that grows with the data: part names as keywords of type and brand."""
    return table(spark, sf, "part").select(
        F.col("p_type").alias("main"),
        F.col("p_brand").alias("sub"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ,")), F.lit(","), F.col("p_name")).alias("keywords"),
    )


def opening_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon as large as the table: how each document begins, as a keyword of its language and source."""
    start = F.substring("text", 1, 14)
    docs = table(spark, sf, "documents").filter(F.length(F.trim(start)) >= 4)
    return docs.select(F.coalesce("lang", F.lit("none")).alias("main"), F.coalesce("source", F.lit("none")).alias("sub"), start.alias("keyword")).distinct()


def stop_words(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(w,) for w in STOP_WORDS], ["word"])


def event_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Events as cache writes of repeated keys."""
    return table(spark, sf, "events").select(
        F.md5(F.col("user_id").cast("string")).alias("cache_key"),
        F.col("event_type").alias("value"),
        F.col("ts").cast("timestamp_ntz").alias("written_at"),
    )


def cache_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of orders as requests; some have a cached value."""
    key = F.col("o_custkey").cast("string")
    return table(spark, sf, "orders").select(F.md5(key).alias("cache_key"), key.alias("text"))

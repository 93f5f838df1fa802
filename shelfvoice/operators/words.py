"""Word counts and the word lists they use."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfvoice.functions.text import plain_words, tokenise, trim_text
from shelfvoice.operators.joins import fits_broadcast
from shelfvoice.schema import CLOUD_SIZE, MIN_WORD_LENGTH, WORD_TABLE_SIZE
from shelfvoice.sources.readers import literal_table


def default_stop_words(spark: SparkSession) -> DataFrame:
    """Spark's own English stop list as ``(word)``."""
    return literal_table(spark, [(w,) for w in StopWordsRemover.loadDefaultStopWords("english")], ["word"])


def union_words(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("word")
    for words in lists[1:]:
        out = out.union(words.select("word"))
    return out.distinct()


def split_words(df: DataFrame, column: str) -> DataFrame:
    """Words of comma-joined entries: trimmed, lower case, without blanks or repeats."""
    parts = df.select(F.explode(F.split(column, ",")).alias("w"))
    return parts.select(F.lower(trim_text(F.col("w"))).alias("word")).filter("word <> ''").distinct()


def add_words(words: DataFrame, entries: DataFrame, column: str) -> DataFrame:
    return union_words(words, split_words(entries, column))


def remove_words(words: DataFrame, removed: DataFrame) -> DataFrame:
    return words.join(removed.select("word").distinct(), "word", "left_anti")


def stop_tokens(stop: DataFrame) -> DataFrame:
    """Stop words as the tokeniser sees them (``don't`` is ``don`` and ``t``)."""
    return stop.select(F.explode(tokenise(F.col("word"))).alias("word")).distinct()


def without(counts: DataFrame, words: DataFrame) -> DataFrame:
    """Counts of words that are not listed.

    Counts already have one row per word and are partitioned by it, so a list
    too long to broadcast shuffles only itself.
    """
    listed = F.broadcast(words) if fits_broadcast(words) else words
    return counts.join(listed, "word", "left_anti")


def word_freq(
    df: DataFrame, stop: DataFrame | None = None, negative: DataFrame | None = None, column: str = "Content"
) -> DataFrame:
    """How often each word of three or more characters occurs.

    The lists apply to counts, one row per word. Catalyst may still test a
    broadcast list before it counts; a longer list meets the vocabulary only.
    """
    words = df.select(F.explode(plain_words(F.col(column), MIN_WORD_LENGTH)).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if stop is not None:
        counts = without(counts, stop_tokens(stop))
    if negative is not None:
        counts = without(counts, negative.select("word").distinct())
    return counts


def top_words(counts: DataFrame, n: int = WORD_TABLE_SIZE) -> DataFrame:
    """Most frequent words; equal counts in word order."""
    return counts.orderBy(F.desc("n"), "word").limit(n)


def cloud_weights(counts: DataFrame, n: int = CLOUD_SIZE) -> DataFrame:
    """Most frequent words with their weight relative to the first."""
    largest = F.max("n").over(W.partitionBy())  # over the n rows kept
    return top_words(counts, n).withColumn("weight", F.col("n") / largest)


def vocab_stats(all_reviews: DataFrame, analysed: DataFrame, counts: DataFrame) -> DataFrame:
    """Reviews in all, reviews analysed and distinct words, as one row."""
    total = all_reviews.agg(F.count(F.lit(1)).alias("n"))
    used = analysed.agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("n_words")).select(
        total.scalar().alias("n_reviews"), used.scalar().alias("n_analysed"), "n_words"
    )

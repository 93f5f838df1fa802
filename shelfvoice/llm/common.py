"""Small helpers that several operators here share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfvoice.sources.workspace import stage

__all__ = ["col", "located", "partitions", "range_buckets", "ship", "stage", "table", "tokenizer_path"]

_shipped: set[str] = set()


def col(name: str) -> Column:
    """A column by its exact name, also with dots or blanks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file is; resolved where it is called."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def range_buckets(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Ascending integer bounds that cut the key into about equal parts.

    One row of at most ``buckets`` numbers reaches the driver. Keys equal to a
    bound belong to the part on its right.
    """
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(col(key), shares, 100 * buckets).alias("b")).first()[0]
    return sorted(set(found or []))


_BLOCK = 256


def located(text: Column, pattern: str) -> Column:
    """Array of ``(gap, hit, start, next)`` for the matches of a pattern that matches no empty text.

    ``gap`` and ``next`` are the texts before and after the hit, up to its
    neighbours. Starts are sums of lengths, taken in blocks so that a text with
    very many matches costs no square of their number. No match: empty.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    let = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  evaluates the value once

    def listed(s: Column) -> Column:
        hits, gaps, n = s["h"], s["g"], F.size(s["h"])
        lengths = F.zip_with(hits, F.slice(gaps, 1, n), lambda h, g: F.length(h) + F.length(g))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda k: total(F.slice(lengths, k * _BLOCK + 1, F.lit(_BLOCK))))
        sums = let(F.struct(lengths.alias("l"), blocks.alias("b")), lambda w: F.struct(w["l"].alias("l"), F.transform(F.sequence(F.lit(0), F.size(w["b"]) - 1), lambda k: total(F.slice(w["b"], 1, k))).alias("t")))
        return let(sums, lambda v: F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(hits, gaps, v, i)))

    def one(hits: Column, gaps: Column, v: Column, i: Column) -> Column:
        gap, block = F.get(gaps, i), F.floor(i / _BLOCK).cast("int")
        at = F.get(v["t"], block) + total(F.slice(v["l"], block * _BLOCK + 1, i % _BLOCK)) + F.length(gap)
        return F.struct(gap.alias("gap"), F.get(hits, i).alias("hit"), at.cast("long").alias("start"), F.get(gaps, i + 1).alias("next"))

    whole = F.coalesce(text, F.lit(""))
    kind = "array<struct<gap:string,hit:string,start:bigint,next:string>>"
    found = F.struct(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)).alias("h"), F.split(whole, pattern, -1).alias("g"))
    return let(found, lambda s: F.when(F.size(s["h"]) > 0, listed(s)).otherwise(F.array().cast(kind)))


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once an application, so that tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "shelfvoice_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)

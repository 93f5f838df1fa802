"""Result cache as a table ``(cache_key, value, written_at, status)``.

The table is a folder of parts, each a Parquet table by day, and a small log
that names them. A part counts once its log row is written, which is one file:
an interrupted append or compaction leaves the table as it was. A compaction is
a part of its own, whose log row names the parts it replaces and no others, so
what is appended meanwhile stays. A plain table by day, made by other means, is
read as the first part.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfvoice.operators.positions import Key, find_slice, rows_between
from shelfvoice.schema import CACHE_TTL_DAYS
from shelfvoice.sources.readers import scan_files

_LOG_SCHEMA = "version long, part string, parent string, replaces array<string>"
#: Name in the log of the files directly under the folder.
_PLAIN = "plain"
_BLOOM = {"parquet.bloom.filter.enabled#cache_key": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number#cache_key": "10"}
#: Keys up to which a lookup names them to the scan, and how many one list holds: a scan turns longer lists into a range.
LOOKUP_KEYS, _LIST_KEYS = 1_000, 10
CACHE_SCHEMA = "cache_key string, value string, written_at timestamp_ntz, status string, written_on date"


def as_now(now: datetime | Column | None) -> Column:
    if now is None:
        return F.current_timestamp().cast("timestamp_ntz")
    # As text: a datetime literal would pass through the session's time zone.
    return now if isinstance(now, Column) else F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def _fresh(now: datetime | Column | None, ttl_days: float) -> Column:
    return F.col("written_at") > as_now(now) - F.lit(timedelta(days=ttl_days))


def valid_entries(cache: DataFrame, now=None, ttl_days: float = CACHE_TTL_DAYS) -> DataFrame:
    """Newest unexpired success of each key as ``(cache_key, value, written_at)``."""
    usable = cache.filter(_fresh(now, ttl_days))
    if "status" in cache.columns:
        usable = usable.filter(F.col("status") == "done")
    newest = usable.groupBy("cache_key").agg(F.max(F.struct("written_at", "value")).alias("last"))
    return newest.select("cache_key", "last.value", "last.written_at")


def for_keys(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cache as far as ``keys``, a staged table of distinct keys, asks for it.

    A few keys are named to the scan, which then skips the row groups and pages
    that cannot hold them by Bloom filters and key ranges. More keys leave the
    cache as it is: they touch most row groups, and the join decides alone.
    """
    if keys.count() > LOOKUP_KEYS:
        return cache
    named = sorted(r.cache_key for r in keys.filter("cache_key IS NOT NULL").collect())
    lists = [F.col("cache_key").isin(named[k : k + _LIST_KEYS]) for k in range(0, len(named), _LIST_KEYS)]
    return cache.filter(reduce(lambda a, b: a | b, lists, F.lit(False)))


def split_requests(requests: DataFrame, cache: DataFrame, now=None, ttl_days: float = CACHE_TTL_DAYS) -> DataFrame:
    """Distinct requested keys with their cached value, if any, and ``is_hit``."""
    keys = requests.select("cache_key").distinct()
    found = keys.join(valid_entries(cache, now, ttl_days).select("cache_key", "value"), "cache_key", "left")
    return found.withColumn("is_hit", F.col("value").isNotNull())


def cache_report(cache: DataFrame, now=None, ttl_days: float = CACHE_TTL_DAYS) -> DataFrame:
    fresh = _fresh(now, ttl_days)
    return cache.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(fresh).alias("n_valid"),
        F.count_if(~fresh).alias("n_expired"),
    )


def retain(cache: DataFrame, now=None, ttl_days: float = CACHE_TTL_DAYS, max_items: int | None = None) -> DataFrame:
    """Entries that stay: newest of each key, unexpired and, if a bound is named, the ``max_items`` latest."""
    if max_items is None:
        return valid_entries(cache, now, ttl_days)
    # One moment for all passes, or entries would expire between them.
    now = cache.sparkSession.range(1).select(as_now(now)).first()[0]
    order = [Key("written_at", ascending=False), Key("cache_key")]
    # The bound is sought on keys and times alone; values are read for the entries near or above it.
    newest = valid_entries(cache, now, ttl_days).select("cache_key", "written_at")
    part = find_slice(newest, order, 0, max_items)
    if part is None:
        return valid_entries(cache, now, ttl_days).limit(0)
    if part.high is not None:
        # A kept entry's newest row is not before the bound, so older rows need no grouping.
        cache = cache.filter(F.col("written_at") >= part.high[0])
    return rows_between(part.of(valid_entries(cache, now, ttl_days)), order, 0, max_items)


def compact_cache(spark: SparkSession, path: str, now=None, ttl_days: float = CACHE_TTL_DAYS, max_items: int | None = None) -> None:
    """Replace the parts of the cache table by one: one entry a key, nothing expired, at most ``max_items`` if named.

    Readers see the old parts until the new one is whole. Parts that the
    compaction before replaced are emptied now, so a reader has the time from
    one compaction to the next to finish. Of two compactions at once one wins;
    the other's part is ignored and nothing is lost.
    """
    state = _state(spark, path)
    kept = retain(_read_parts(spark, path, state.live, now, ttl_days), now, ttl_days, max_items)
    _replace(kept.withColumns({"status": F.lit("done"), "written_on": F.to_date("written_at")}), path, state)
    for part in state.replaced_last:
        if part != _PLAIN:
            spark.createDataFrame([], "nothing int").coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part}")


def clear_cache(spark: SparkSession, path: str) -> None:
    """Leave an empty cache table."""
    _replace(spark.createDataFrame([], CACHE_SCHEMA), path, _state(spark, path))


def _replace(table: DataFrame, path: str, state: _State) -> None:
    part = _write_part(table, path)
    _commit(table.sparkSession, path, (state.version + 1, part, state.base, state.live))


def append_results(results: DataFrame, path: str, now=None) -> None:
    """Append successes as a new part, by day so that old days are not read."""
    stamped = results.filter(F.col("status") == "done").select(
        "cache_key", "value", as_now(now).alias("written_at"), "status"
    )
    part = _write_part(stamped.withColumn("written_on", F.to_date("written_at")), path)
    _commit(results.sparkSession, path, (None, part, None, None))


def _write_part(table: DataFrame, path: str) -> str:
    """A day's rows in key order, with a Bloom filter of the keys a row group, as large as its keys ask for."""
    part = uuid.uuid4().hex
    ordered = table.sortWithinPartitions("written_on", "cache_key").write.partitionBy("written_on")
    ordered.options(**_BLOOM).parquet(f"{path}/part={part}")
    return part


def _commit(spark: SparkSession, path: str, row: tuple) -> None:
    """One row, one task, one file: it is there or not."""
    spark.createDataFrame([row], _LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/_log")


@dataclass(frozen=True)
class _State:
    """What the log says: the newest compaction (``base``), and the parts that hold the table."""

    version: int
    base: str | None
    live: list[str]
    replaced_last: list[str]


def _state(spark: SparkSession, path: str) -> _State:
    """Reads the log, which has one short row for each append or compaction."""
    log = _read_or_none(spark, _LOG_SCHEMA, f"{path}/_log")
    rows = [] if log is None else log.collect()
    compactions = {r.part: r for r in rows if r.version is not None}
    newest = max(compactions.values(), key=lambda r: (r.version, r.part), default=None)
    gone, step = set(), newest
    while step is not None:
        gone |= set(step.replaces)
        step = compactions.get(step.parent)
    parts = [_PLAIN, *sorted(r.part for r in rows if r.version is None)] + ([newest.part] if newest else [])
    live = [p for p in parts if p not in gone]
    return _State(newest.version if newest else 0, newest and newest.part, live, list(newest.replaces) if newest else [])


def _read_or_none(spark: SparkSession, schema: str, *paths: str, base: str | None = None) -> DataFrame | None:
    reader = spark.read.schema(schema)
    try:
        return (reader.option("basePath", base) if base else reader).parquet(*paths)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _read_parts(spark: SparkSession, path: str, parts: list[str], now, ttl_days: float | None) -> DataFrame:
    named = [f"{path}/part={p}" for p in parts if p != _PLAIN]
    plain = _read_or_none(spark, CACHE_SCHEMA, f"{path}/written_on=*", base=path) if _PLAIN in parts else None
    tables = [] if plain is None else [plain]
    if named:
        tables.append(spark.read.schema(f"{CACHE_SCHEMA}, part string").option("basePath", path).parquet(*named).drop("part"))
    table = reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], CACHE_SCHEMA)
    if ttl_days is None:
        return table
    oldest = F.to_date(as_now(now) - F.lit(timedelta(days=ttl_days)))
    return table.filter(F.col("written_on") >= oldest)


def read_cache(spark: SparkSession, path: str, now: datetime | None = None, ttl_days: float | None = None) -> DataFrame:
    """The cache table, empty where there is none yet; with ``now`` and ``ttl_days`` expired day folders are not read."""
    return _read_parts(spark, path, _state(spark, path).live, now, ttl_days)


def storage_report(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of each folder and, with ``folder`` NULL, overall."""
    files = scan_files(spark, path).withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return files.rollup("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))

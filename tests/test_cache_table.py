"""The cache table: appends and compactions that are interrupted or meet each other lose nothing."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfvoice.operators import cache as K

NOW = datetime(2024, 6, 1)


def add(spark, path, *keys, day=0):
    rows = spark.createDataFrame([(k, f"{k}-{day}", "done") for k in keys], "cache_key string, value string, status string")
    K.append_results(rows, path, NOW - timedelta(days=day))


def held(spark, path):
    return sorted((r.cache_key, r.value) for r in K.read_cache(spark, path).collect())


def test_a_failure_before_the_commit_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    add(spark, path, "a", "b", day=3)
    add(spark, path, "a")
    before = held(spark, path)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(K, "_commit", fail)
        for act in (lambda: K.compact_cache(spark, path, NOW), lambda: add(spark, path, "c"), lambda: K.clear_cache(spark, path)):
            with pytest.raises(OSError):
                act()
    assert held(spark, path) == before
    K.compact_cache(spark, path, NOW)
    assert held(spark, path) == [("a", "a-0"), ("b", "b-3")]


def test_an_append_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    add(spark, path, "a", day=1)
    commit = K._commit

    def late(session, where, row):
        if row[0] is not None:
            monkeypatch.setattr(K, "_commit", commit)
            add(spark, path, "b")
        commit(session, where, row)

    monkeypatch.setattr(K, "_commit", late)
    K.compact_cache(spark, path, NOW)
    assert held(spark, path) == [("a", "a-1"), ("b", "b-0")]
    K.compact_cache(spark, path, NOW)
    assert held(spark, path) == [("a", "a-1"), ("b", "b-0")]


def test_of_two_compactions_at_once_one_counts(spark, tmp_path):
    path = str(tmp_path / "cache")
    add(spark, path, "a", day=1)
    old = K._state(spark, path)
    add(spark, path, "b")
    K.compact_cache(spark, path, NOW)
    slow = K._read_parts(spark, path, old.live, None, None)
    K._replace(slow.withColumn("written_on", F.to_date("written_at")), path, old)
    assert held(spark, path) == [("a", "a-1"), ("b", "b-0")]
    add(spark, path, "c")
    K.compact_cache(spark, path, NOW)
    assert held(spark, path) == [("a", "a-1"), ("b", "b-0"), ("c", "c-0")]


def test_a_reader_outlasts_one_compaction_and_older_parts_go(spark, tmp_path):
    path = str(tmp_path / "cache")
    add(spark, path, "a", "b")
    [first] = [p for p in K._state(spark, path).live if p != K._PLAIN]
    reader = K.read_cache(spark, path)
    K.compact_cache(spark, path, NOW)
    assert reader.count() == 2
    K.compact_cache(spark, path, NOW)
    assert not list(Path(path, f"part={first}").glob("written_on=*")) and len(held(spark, path)) == 2


def test_a_plain_table_is_the_first_part(spark, tmp_path):
    path = str(tmp_path / "cache")
    add(spark, path, "x")
    plain = str(tmp_path / "plain")
    K.read_cache(spark, path).write.partitionBy("written_on").parquet(plain)
    assert held(spark, plain) == [("x", "x-0")]
    add(spark, plain, "y", day=1)
    assert held(spark, plain) == [("x", "x-0"), ("y", "y-1")]
    K.compact_cache(spark, plain, NOW, max_items=1)
    assert held(spark, plain) == [("x", "x-0")]
    folders = {r.folder for r in K.storage_report(spark, plain).collect()}
    assert "written_on=2024-06-01" in folders and "_log" not in folders
    K.clear_cache(spark, plain)
    assert held(spark, plain) == [] and K.read_cache(spark, plain, NOW, 30).count() == 0


def rows_scanned(df):
    found = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return found, sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_few_keys_read_few_rows(spark, tmp_path):
    path, n = str(tmp_path / "cache"), 120_000
    rows = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("cache_key"), F.col("id").cast("string").alias("value"), F.lit("done").alias("status"))
    K.append_results(rows.repartition(2), path, NOW)
    cache = K.read_cache(spark, path)

    def keys(*ids):
        return spark.createDataFrame([(i,) for i in ids], "id string").select(F.md5("id").alias("cache_key"))

    found, scanned = rows_scanned(K.for_keys(cache, keys("7", "119999")))
    assert {r.value for r in found} == {"7", "119999"} and 2 <= scanned < n
    # A key between others that is not there: only the Bloom filters can tell.
    found, scanned = rows_scanned(K.for_keys(cache, keys("absent")))
    assert found == [] and scanned == 0
    many = [str(i) for i in range(25)]
    assert {r.value for r in K.for_keys(cache, keys(*many)).collect()} == set(many)
    assert K.for_keys(cache, keys("7").limit(0)).collect() == []
    assert K.for_keys(cache, spark.createDataFrame([(None,)], "cache_key string")).collect() == []


def test_more_keys_leave_the_cache_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    add(spark, path, "a", "b", "c")
    monkeypatch.setattr(K, "LOOKUP_KEYS", 1)
    asked = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    assert {r.cache_key for r in K.for_keys(K.read_cache(spark, path), asked).collect()} == {"a", "b", "c"}
    part = next((tmp_path / "cache").glob("part=*/written_on=*/*.parquet"))
    assert part.stat().st_size < 50_000, "a small part must not carry a large filter"

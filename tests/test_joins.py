"""The salted lookup against the plain join, with one key holding a third of the rows."""

import pytest
from pyspark.sql import functions as F

from shelfvoice.operators import joins as J


@pytest.fixture
def skewed(spark):
    key = (
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string")))
    )
    return spark.range(9000).select("id", key.alias("k"))


@pytest.fixture
def named(spark):
    return spark.range(0, 100, 2).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), (F.col("id") * 10).alias("v")
    ).union(spark.createDataFrame([("hot", 7), ("unused", 8)], "k string, v long"))


def result(df):
    return sorted((r.id, r.k or "", r.v if r.v is not None else -1) for r in df.collect())


def test_salted_equals_plain(skewed, named):
    want = result(skewed.join(named, "k", "left"))
    assert result(J.salted_left(skewed, named, "k", F.col("id"))) == want and len(want) == 9000


def test_lookup_switches_on_measured_size(spark, skewed, named, monkeypatch):
    want = result(J.lookup_left(skewed, named, "k", F.col("id")))
    calls = []
    monkeypatch.setattr(J, "salted_left", lambda *a, f=J.salted_left: calls.append(1) or f(*a))
    monkeypatch.setattr(J, "BROADCAST_MAX_ROWS", 10)
    assert result(J.lookup_left(skewed, named, "k", F.col("id"))) == want and calls == [1]
    monkeypatch.setattr(J, "BROADCAST_MAX_ROWS", 1000)
    monkeypatch.setattr(J, "BROADCAST_MAX_BYTES", 100)
    assert result(J.lookup_left(skewed, named, "k", F.col("id"))) == want and calls == [1, 1]


def test_only_hot_keys_are_split(skewed):
    got = {r.k: r._salts for r in J.hot_keys(skewed, "k", 8).collect()}
    assert list(got) == ["hot"] and got["hot"] in (3, 4)


def test_hot_rows_land_in_several_partitions(spark, skewed, named):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.salted_left(skewed, named, "k", F.col("id"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 3 * 9000 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

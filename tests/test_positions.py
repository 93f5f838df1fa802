"""Rows by position: against sorted lists, at sample sizes that need several rounds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfvoice.operators import cache as K
from shelfvoice.operators import positions as P


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(P, "SAMPLE_KEYS", 1000)
    monkeypatch.setattr(P, "SLACK_ROWS", 20)


@pytest.fixture
def numbered(monkeypatch):
    """Rows of each slice that is sorted and written."""
    seen = []

    def counted(df, *a, **b):
        seen.append(df.count())
        return assign(df, *a, **b)

    assign = P.assign_row_ids
    monkeypatch.setattr(P, "assign_row_ids", counted)
    return seen


def test_a_short_range_sorts_few_rows(spark, small, numbered):
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("ID"), F.col("id").alias("other")).coalesce(3)
    for start, end in [(0, 10), (9_990, 10_010), (19_980, 30_000)]:
        got = sorted(r.ID for r in P.rows_between(df, [P.Key("ID")], start, end).collect())
        assert got == list(range(start, min(end, 20_000)))
    assert max(numbered) <= 2 * 20 + 20


def test_nothing_between(spark, small):
    df = spark.range(50).withColumnRenamed("id", "ID")
    assert P.rows_between(df, [P.Key("ID")], 10, 10).count() == 0
    assert P.rows_between(df, [P.Key("ID")], 60, 70).count() == 0
    assert P.rows_between(df.filter("ID < 0"), [P.Key("ID")], 0, 10).count() == 0
    assert P.rows_between(df, [P.Key("ID")], -5, 3).count() == 3


_DAY = datetime(2024, 3, 31, 1, 30)
_VALUES = {
    "string": lambda r: r.choice(["", "a", "é", "Z", "aa", "it's", "back\\slash"]) + str(r.randrange(400)),
    "double": lambda r: r.choice([float("inf"), float("-inf"), 0.1, 1e-300, r.uniform(-9, 9)]),
    "decimal(20,6)": lambda r: __import__("decimal").Decimal(r.randrange(10**12)).scaleb(-6),
    "timestamp": lambda r: _DAY + timedelta(microseconds=r.randrange(10**11)),
    "timestamp_ntz": lambda r: _DAY + timedelta(microseconds=r.randrange(10**11)),
    "date": lambda r: (_DAY + timedelta(days=r.randrange(3000))).date(),
    "boolean": lambda r: r.random() < 0.5,
    "binary": lambda r: bytes(r.randrange(256) for _ in range(r.randrange(4))),
}


@pytest.mark.parametrize("kind", _VALUES)
def test_orders_of_every_type_with_missing_values(spark, small, kind):
    ascending = len(kind) % 2 == 0
    r = random.Random(kind)
    rows = [(None if r.random() < 0.05 else _VALUES[kind](r), i) for i in range(1500)]
    df = spark.createDataFrame(rows, f"k {kind}, other int").coalesce(2)
    order = [P.Key("k", ascending), P.Key("other")]
    # Missing values are the least: first when rising, last when falling.
    ranked = sorted(rows, key=lambda x: x[1])
    ranked = sorted((x for x in ranked if x[0] is not None), key=lambda x: x[0], reverse=not ascending)
    missing = sorted((x for x in rows if x[0] is None), key=lambda x: x[1])
    ranked = missing + ranked if ascending else ranked + missing
    for start, end in [(0, 40), (1440, 1480)]:
        got = {x.other for x in P.rows_between(df, order, start, end).collect()}
        assert got == {i for _, i in ranked[start:end]}


def test_ties_are_cut_by_the_row_and_parts_fit_together(spark, small, numbered):
    df = spark.range(4000).select((F.col("id") % 2).alias("ID"), F.col("id").alias("other")).coalesce(3)
    cuts = [0, 30, 1990, 2010, 4000]
    parts = [[r.other for r in P.rows_between(df, [P.Key("ID")], a, b).collect()] for a, b in zip(cuts, cuts[1:])]
    assert [len(p) for p in parts] == [30, 1960, 20, 1990]
    assert sorted(sum(parts, [])) == list(range(4000))
    assert all(i % 2 == 0 for i in parts[0] + parts[1]) and all(i % 2 for i in parts[3])
    numbered.clear()
    P.rows_between(df, [P.Key("ID")], 1000, 1020).collect()
    assert numbered[0] <= 60


def test_equal_rows_are_counted_one_by_one(spark, small):
    df = spark.range(3000).select(F.lit(1).alias("ID"), F.lit("same").alias("text"))
    assert P.rows_between(df, [P.Key("ID")], 100, 350).count() == 250
    several = df.union(df.withColumn("ID", F.lit(0)).limit(50))
    assert [r.ID for r in P.rows_between(several, [P.Key("ID")], 45, 55).orderBy("ID").collect()] == [0] * 5 + [1] * 5


def test_bounds_reach_the_scan(spark, small, tmp_path):
    spark.range(5000).withColumnRenamed("id", "ID").withColumn("text", F.lit("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    part = P.find_slice(df.select("ID"), [P.Key("ID")], 2500, 2510)
    plan = part.of(df)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ID," in plan and "LessThan(ID," in plan and part.rows <= 40


def test_retention_by_keys_and_times(spark, small, numbered):
    now = datetime(2024, 6, 1)
    cache = spark.range(6000).select(
        F.concat(F.lit("k"), (F.col("id") % 3000).cast("string")).alias("cache_key"),
        F.col("id").cast("string").alias("value"),
        (F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.col("id") % 500)).alias("written_at"),
        F.lit("done").alias("status"),
    )
    everything = K.retain(cache, now, 30).collect()
    best = sorted(everything, key=lambda r: (-r.written_at.timestamp(), r.cache_key))[:37]
    assert sorted(K.retain(cache, now, 30, 37).collect()) == sorted(best)
    assert max(numbered) <= 2 * 37 + 20
    assert K.retain(cache, None, 30, 5).count() == 0 and K.retain(cache, now, 30, 0).count() == 0

"""Cleaning, brand lookup and row ids on toy tables."""

import pytest
from pyspark.sql import functions as F

from shelfvoice.operators import brands as B
from shelfvoice.operators import clean as C
from shelfvoice.operators import joins
from shelfvoice.operators import rowids as R
from shelfvoice.plans.pipelines import process_reviews
from shelfvoice.schema import PROCESSED, REQUIRED
from shelfvoice.sources import readers, writers


def column(df, name):
    return [r[name] for r in df.orderBy("ID").collect()]


def test_processed_table(processed):
    assert processed.columns == PROCESSED
    assert column(processed, "ID") == [1, 2, 3, 4, 5]
    assert column(processed, "Review Type") == ["positive", "negative", "neutral", None, "positive"]
    assert column(processed, "Brand") == ["Two", "Nine", None, "Nine", "Nine"]
    assert column(processed, "Model") == ["red", "red", "blue", None, "red"]
    assert column(processed, "Content")[2] is None
    assert [d and d.day for d in column(processed, "Date")] == [2, 20, None, 1, 3]


def test_without_brands(toy_reviews):
    out = process_reviews(toy_reviews, order_by=["row"])
    assert "Brand" not in out.columns and out.count() == 5


def test_missing_columns_are_named(toy_reviews):
    with pytest.raises(ValueError, match="Rating"):
        process_reviews(toy_reviews.drop("Rating"), order_by=["row"])
    with pytest.raises(ValueError, match="order_by"):
        process_reviews(toy_reviews)


def test_numeric_input_keeps_its_values(spark):
    raw = spark.createDataFrame([(float("nan"),), (4.0,)], "Rating double").withColumn("Date", F.current_date())
    assert [r.Rating for r in C.coerce_types(raw).collect()] == [None, 4.0]


def test_dedupe_keeps_last(toy_brands):
    got = {r.ASIN: r.Brand for r in B.dedupe_brands(B.normalise_brands(toy_brands), ["ord"]).collect()}
    assert got == {"C9": "Nine", "C1": "One", "C2": "Two"}


def test_blank_brand_is_no_match(spark, toy_reviews):
    brands = spark.createDataFrame([("ZZ", "  ", None, 1), (None, "x", " ", 2)], "ASIN string, Brand string, `Parent ASIN` string, ord int")
    out = process_reviews(toy_reviews, brands, order_by=["row"], brand_order=["ord"])
    assert column(out, "Brand") == [None] * 5


def test_brands_without_parent(toy_reviews, toy_brands):
    out = process_reviews(toy_reviews, toy_brands.drop("Parent ASIN"), order_by=["row"], brand_order=["ord"])
    assert column(out, "Brand") == [None, "Nine", None, "Nine", "Nine"]


def test_match_report(toy_reviews, toy_brands):
    row = B.brand_match_report(toy_reviews, toy_brands, ["ord"]).first()
    assert (row.total, row.matched, row.match_rate, row.first_round, row.second_round) == (5, 4, 80.0, 3, 1)


def test_ids_with_ties_and_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("v")).repartition(13)
    out = R.assign_row_ids(df, ["k"]).collect()
    assert sorted(r.ID for r in out) == list(range(1, 5001))
    ordered = [r.k for r in sorted(out, key=lambda r: r.ID)]
    assert ordered == sorted(ordered)


def test_ids_descending_and_null_keys(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    out = R.assign_row_ids(df, [F.desc_nulls_last("k")]).orderBy("ID").collect()
    assert [(r.ID, r.k) for r in out] == [(1, 3), (2, 1), (3, None)]


def test_ids_of_empty_table(spark):
    assert R.assign_row_ids(spark.range(0), ["id"]).count() == 0


def test_input_order_over_files(spark, tmp_path):
    path = str(tmp_path / "reviews")
    frame = spark.range(1000).select(*[F.col("id").cast("string").alias(c) for c in REQUIRED])
    frame.repartition(5).write.parquet(path)
    got = process_reviews(readers.read_reviews(spark, path, "parquet")).select("ID", "Asin").collect()
    files = sorted((tmp_path / "reviews").glob("*.parquet"))
    want = [r.Asin for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert [r.Asin for r in sorted(got, key=lambda r: r.ID)] == want


def test_csv_fields_and_order(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    head = "Asin,Title,Content,Model,Rating,Date,Extra\n"
    (folder / "a.csv").write_text(head + 'A1,"say ""hi""","two\nlines, here",m,5,2024-01-01,x\nA2,,,,,,\n')
    (folder / "b.csv").write_text(head + "A3,t,c,m,bad,bad,x\n")
    raw = readers.read_reviews(spark, str(folder), "csv")
    out = process_reviews(raw).orderBy("ID").collect()
    assert out == process_reviews(raw, order_by=readers.POSITION_COLUMNS).orderBy("ID").collect()
    assert [r.Asin for r in out] == ["A1", "A2", "A3"]
    assert out[0].Title == 'say "hi"' and out[0].Content == "two\nlines, here"
    assert out[1].Content is None and out[2].Rating is None


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_files_number_rows_in_input_order(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        frame = spark.range(3000).select(*[F.col("id").cast("string").alias(c) for c in REQUIRED])
        writers.write_results(frame.repartition(4), path, fmt)
        got = process_reviews(readers.read_reviews(spark, path, fmt)).select("ID", "Asin").collect()
        want = []
        for f in sorted((tmp_path / fmt).glob(f"*.{fmt}")):
            lines = f.read_text().splitlines()[1 if fmt == "csv" else 0 :]
            want += [line.split(",")[0].split(":")[-1].strip('"') for line in lines]
        assert [r.Asin for r in sorted(got, key=lambda r: r.ID)] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tsv_is_tab_separated_with_header(spark, tmp_path):
    path = str(tmp_path / "tsv")
    writers.write_tsv(spark.createDataFrame([(1, None, "a\tb")], "ID int, x string, y string").coalesce(1), path)
    [part] = (tmp_path / "tsv").glob("*.csv")
    assert part.read_text() == 'ID\tx\ty\n1\t\t"a\tb"\n'


def test_lexicon_and_word_files(spark, tmp_path):
    nested, flat, words = tmp_path / "n.json", tmp_path / "f.json", tmp_path / "w.json"
    nested.write_text('{"m": {"s": "a, b", "t": "c"}}')
    flat.write_text('{"s": "a,b"}')
    words.write_text('["x", "y"]')
    got = readers.read_lexicon_json(spark, str(nested)).orderBy("sub").collect()
    assert [tuple(r) for r in got] == [("m", "s", "a, b"), ("m", "t", "c")]
    assert [tuple(r) for r in readers.read_lexicon_json(spark, str(flat)).collect()] == [(None, "s", "a,b")]
    assert [r.word for r in readers.read_words_json(spark, str(words)).collect()] == ["x", "y"]


@pytest.mark.parametrize("small", [True, False])
def test_file_order_over_many_splits(spark, tmp_path, monkeypatch, small):
    """Ids of many files of very unequal sizes, with offsets broadcast or joined by salted splits."""
    if not small:
        monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 1)
    path, at, sizes = str(tmp_path / "parts"), 0, [3, 1, 4000, 0, 7, 2, 900, 1, 1, 5]
    for k, n in enumerate(sizes):
        spark.range(at, at + n, numPartitions=1).withColumnRenamed("id", "place").write.parquet(f"{path}/part={k:03d}")
        at += n
    df = readers.with_position(spark.read.parquet(path), "parquet")
    made = R.ids_in_file_order(df)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) != small
    rows = made.select("ID", "place").collect()
    assert sorted(r.ID for r in rows) == list(range(1, sum(sizes) + 1)) and all(r.ID == r.place + 1 for r in rows)
    assert R.ids_in_file_order(df.limit(0)).collect() == []

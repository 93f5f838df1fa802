"""Filters, statistics and word counts on the toy table."""

from pyspark.sql import functions as F

from shelfvoice.operators import filters as Q
from shelfvoice.operators import profile as P
from shelfvoice.operators import stats as S
from shelfvoice.operators import words as V
from shelfvoice.plans import views as T


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ids(df):
    return sorted(r.ID for r in df.collect())


def test_type_stats(processed):
    assert rows(S.review_type_stats(processed)) == [("negative", 1, 20.0), ("neutral", 1, 20.0), ("positive", 2, 40.0)]


def test_group_stats(processed):
    assert rows(S.group_stats(processed, "Asin")) == [
        ("C9", 2, 3.0, 1.41),
        ("P1", 1, 5.0, None),
        ("ZZ", 1, 3.0, None),
    ]
    assert [(r.grp, r.n_reviews) for r in S.group_stats(processed, ["Asin", "Model"]).orderBy("grp").collect()] == [
        ("C9 - red", 2),
        ("P1 - red", 1),
        ("ZZ - blue", 1),
    ]


def test_types_of_group(processed):
    got = {r.grp: r.type_dist for r in S.group_stats(processed, "Asin", with_types=True).collect()}
    assert got == {"C9": {"positive": 1, "negative": 1}, "P1": {"positive": 1}, "ZZ": {"neutral": 1}}


def test_crosstab(processed):
    got = [(r.grp, r.Rating, r.pct) for r in S.rating_crosstab(processed, "Asin").orderBy("grp", "Rating").collect()]
    assert got == [("C9", 2.0, 50.0), ("C9", 4.0, 50.0), ("P1", 5.0, 100.0), ("ZZ", 3.0, 100.0)]
    wide = {r.grp: list(r)[1:] for r in S.rating_crosstab_wide(processed, "Asin").collect()}
    assert wide["C9"] == [0.0, 50.0, 0.0, 50.0, 0.0, 0.0]


def test_ratings_outside_the_scale(processed):
    odd = processed.withColumn("Rating", F.when(F.col("ID") == 1, 7.5).otherwise(F.col("Rating")))
    assert ("P1", 7.5, 1, 100.0) in rows(S.rating_crosstab(odd, "Asin"))


def test_trend(processed):
    assert rows(S.rating_trend(processed)) == [("2024-01", 3.5), ("2024-02", 4.0)]


def test_dense_types_of_nothing(processed):
    assert [tuple(r) for r in S.dense_types(processed.limit(0)).collect()] == [
        ("positive", 0), ("neutral", 0), ("negative", 0),
    ]


def test_percent_of_nothing(processed):
    none = processed.filter("ID < 0")
    assert S.review_type_stats(none).count() == 0
    assert Q.selectivity(none, F.lit(True)).first().pct_kept is None


def test_filters(processed):
    assert ids(Q.filter_reviews(processed, {"Asin": "C9", "Rating": None, "Brand": "all"})) == [2, 4, 5]
    assert ids(Q.filter_reviews(processed, {"Asin": "C9", "row_range": (1, 3)})) == [4, 5]
    assert ids(Q.filter_reviews(processed, {"Rating": 0})) == []
    assert ids(Q.in_list(processed, "Asin", [])) == [1, 2, 3, 4, 5]
    assert ids(Q.of_review_type(processed, "POSITIVE")) == [1, 5]
    assert ids(Q.with_text(processed, "Content")) == [1, 2, 4, 5]
    assert ids(Q.row_range(processed, 1, 3, dense=True)) == [2, 3]


def test_row_ranges_cut_ties_the_same_way(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("ID"), F.col("id").alias("other"))
    parts = [{r.other for r in Q.row_range(df, a, a + 200).collect()} for a in range(0, 1000, 200)]
    assert [len(p) for p in parts] == [200] * 5 and len(set().union(*parts)) == 1000
    assert {r.other for r in Q.row_range(df, 0, 600).collect()} == parts[0] | parts[1] | parts[2]
    assert Q.row_range(df.union(df), 100, 300).count() == 200


def test_wide_crosstab_loses_no_rating(spark):
    df = spark.createDataFrame([("a", 4.5), ("a", 5.0), ("a", 7.0), ("a", None), ("b", 4.5)], "Asin string, Rating double")
    got = {r.grp: r.asDict() for r in S.rating_crosstab_wide(df, "Asin").collect()}
    assert abs(got["a"]["rating_5"] - 100 / 3) < 1e-9 and abs(got["a"]["rating_other"] - 200 / 3) < 1e-9
    assert got["b"]["rating_other"] == 100.0
    named = S.rating_crosstab_wide(df, "Asin", [4.5, 7]).filter("grp = 'b'").first()
    assert (named.rating_4_5, named.rating_7, named.rating_other) == (100.0, 0.0, 0.0)


def test_profile(processed):
    row = P.dataset_profile(processed).first()
    assert (row.n_rows, row.n_columns, row.enrichable, row.n_texts) == (5, 9, "Title,Content", 5)
    got = {r.column_name: (r.n_present, r.n_missing, r.pct_present) for r in P.completeness(processed, ["Brand"]).collect()}
    assert got == {"Brand": (4, 1, 80.0)}


def test_word_freq(processed):
    got = {r.word: r.n for r in V.word_freq(processed).collect()}
    assert got == {
        "taste": 4, "don": 1, "bitter": 1, "worth": 1, "great": 1, "easy": 1, "swallow": 1, "too": 1, "100": 1, "not": 1,
    }


def test_word_lists(spark, processed):
    stop = spark.createDataFrame([("don't",), ("too",)], "word string")
    entries = spark.createDataFrame([(" Bitter, ,taste",)], "entry string")
    negative = V.split_words(entries, "entry")
    got = {r.word for r in V.word_freq(processed, stop, negative).collect()}
    assert got == {"worth", "great", "easy", "swallow", "100", "not"}
    assert "the" in {r.word for r in V.default_stop_words(spark).collect()}


def test_long_word_list_is_shuffled(spark, processed, monkeypatch):
    from shelfvoice.operators import joins

    small = rows(V.word_freq(processed, V.default_stop_words(spark)))
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 3)
    assert rows(V.word_freq(processed, V.default_stop_words(spark))) == small


def test_cloud_weights(processed):
    got = {r.word: r.weight for r in V.cloud_weights(V.word_freq(processed), 3).collect()}
    assert got["taste"] == 1.0 and got["100"] == 0.25 and len(got) == 3


def test_levels_equal_the_single_reports(spark):
    rows = [("b", "p", "m", 5.0, "positive"), ("b", "p", None, 2.5, "neutral"), (None, "p", "m", None, None), ("b", "q", "m", 1.0, "negative")]
    df = spark.createDataFrame(rows, "Brand string, Asin string, Model string, Rating double, `Review Type` string")
    levels = [["Brand"], ["Asin"], ["Brand", "Asin", "Model"]]
    got = {(r.level, r.grp): r for r in S.group_levels(df, levels).collect()}
    wanted = {}
    for level in levels:
        for r in S.group_stats(df, level, with_types=True).collect():
            wanted[" - ".join(level), r.grp] = r
    assert set(got) == set(wanted)
    for k, r in wanted.items():
        assert (got[k].n_reviews, got[k].avg_rating, got[k].std_rating) == (r.n_reviews, r.avg_rating, r.std_rating)
        assert {t: got[k][f"n_{t}"] for t in ("positive", "neutral", "negative") if got[k][f"n_{t}"]} == r.type_dist
    for level in levels:
        for r in S.rating_crosstab_wide(df, level).collect():
            assert [got[" - ".join(level), r.grp][c] for c in r.asDict() if c != "grp"] == [r[c] for c in r.asDict() if c != "grp"]
    assert S.group_levels(df.limit(0), levels).collect() == []


def test_levels_scan_once(spark):
    reviews = T.line_reviews(spark, "/root/testdata/sf0.001")
    plan = S.group_levels(reviews, [["Asin"], ["Model"], ["Asin", "Model"]])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1

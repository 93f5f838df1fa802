"""Whole jobs from files to files."""

from shelfvoice.operators import enrich, lexicon, stats, words
from shelfvoice.plans.pipelines import process_reviews, tag_reviews
from shelfvoice.schema import REQUIRED
from shelfvoice.sources import readers, writers


def test_files_to_files(spark, tmp_path, toy_reviews):
    source, brand_file, out = str(tmp_path / "in"), tmp_path / "brands.csv", str(tmp_path / "out")
    toy_reviews.select(*REQUIRED, "row").coalesce(1).write.parquet(source)
    brand_file.write_text("ASIN,Brand,Parent ASIN\nC9,Old,PX\nC9,Nine,PX\nC1,One,P1\nC2,Two,P1\n")
    raw = readers.read_reviews(spark, source, "parquet")
    reviews = process_reviews(raw, readers.read_brands(spark, str(brand_file)))
    assert [r.Brand for r in reviews.orderBy("ID").collect()] == ["Two", "Nine", None, "Nine", "Nine"]
    table = lexicon.normalise_lexicon(lexicon.lexicon_from_spec(spark, {"m": {"s": "taste, bitter"}}))
    flagged, by_category, by_keyword = tag_reviews(reviews, table)
    assert flagged.columns[-1] == "is_m__s" and by_category.first().matched == 4
    assert [(r.keyword, r.n) for r in by_keyword.collect()] == [("taste", 3), ("bitter", 1)]
    made = enrich.enrich_columns(flagged, ["Content"], lambda texts: [t.upper() for t in texts], engine="e")
    writers.write_results(writers.export_projection(made.rows, ["Content"], ["Content_zh"], False), out)
    back = spark.read.parquet(out)
    assert back.columns[-1] == "Content_zh" and "Content" not in back.columns
    assert back.filter("ID = 5").first().Content_zh == "TASTE TASTE"
    assert stats.overview(back).first().n_reviews == 5
    assert words.top_words(words.word_freq(reviews), 1).first().word == "taste"


def test_lexicon_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "lexicon")
    table = lexicon.normalise_lexicon(lexicon.lexicon_from_spec(spark, {"m": {"s": "b, a", "t": "c"}, "n": {"s": "d"}}))
    writers.write_lexicon_json(table, path)
    back = lexicon.normalise_lexicon(readers.read_lexicon_json(spark, path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


def test_word_list_round_trip(spark, tmp_path):
    path = str(tmp_path / "words")
    table = spark.createDataFrame([("a",), ("b \"q\"",), ("c\nd",)], "word string")
    writers.write_words_json(table, path)
    assert sorted(r.word for r in readers.read_words_json(spark, path).collect()) == sorted(r.word for r in table.collect())


def test_flat_lexicon_is_upgraded(spark, tmp_path):
    old = tmp_path / "old.json"
    old.write_text('{"kids": "boy,girl", "odd": "x"}')
    preset = spark.createDataFrame([("kids", "people")], "sub string, main string")
    placed = lexicon.upgrade_flat(readers.read_lexicon_json(spark, str(old)), preset, "other")
    assert sorted(map(tuple, placed.collect())) == [("other", "odd", "x"), ("people", "kids", "boy,girl")]


def test_staged_tables_are_removed(spark):
    from shelfvoice.sources import workspace

    workspace.cleanup(spark)
    staged = workspace.stage(spark.range(10), "some")
    assert staged.count() == 10
    assert workspace.cleanup(spark) == 1 and workspace.cleanup(spark) == 0

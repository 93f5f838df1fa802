import random

import pytest
from pyspark.sql import functions as F

from shelfvoice.operators import containment


def frames(spark, texts, entries):
    docs = spark.createDataFrame(list(enumerate(texts)), "ID long, Content string")
    return docs, spark.createDataFrame(entries, "main string, sub string, keyword string")


def held(texts, entries):
    return {(k, w) for k, t in enumerate(texts) if t is not None for _, _, w in entries if w.strip() and w.lower() in t.lower()}


@pytest.mark.parametrize("bound", [2_000_000, 0])
@pytest.mark.parametrize("stretch", [4_096, 5])
def test_pairs_by_brute_force(spark, monkeypatch, bound, stretch):
    """By broadcast and by salted shuffle, with texts cut into stretches; hot grams, short and long keywords."""
    monkeypatch.setattr("shelfvoice.operators.joins.BROADCAST_MAX_ROWS", bound)
    monkeypatch.setattr(containment, "STRETCH", stretch)
    rnd = random.Random(3)
    syllables = ["an", "bo", "Ce", "du", "é", " ", "x", "das ist ", "AB"]
    texts = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(0, 40))) for _ in range(120)] + [None, "", " "] + ["das ist das"] * 80
    entries = [("m", f"s{k % 5}", "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 6)))) for k in range(150)]
    entries += [("m", "s1", w) for w in ("d", "É", "  ", "das ist", "DAS IST", "ab", "zzz", "das ist das")] + entries[:3]
    docs, lexicon = frames(spark, texts, entries)
    got = [(r.id, r.keyword) for r in containment.held_keywords(docs, lexicon).collect()]
    assert len(got) == len(set(got)) and set(got) == held(texts, entries)


def test_statistics_by_brute_force(spark):
    texts = ["Red ring and blue bolt", "RED", None, "", "a ring"]
    entries = [("a", "x", "red"), ("a", "x", "ring"), ("a", "y", "bolt"), ("b", "x", "Red"), ("b", "z", "none of these"), ("b", "z", " ")]
    docs, lexicon = frames(spark, texts, entries)
    n = {tuple(r) for r in containment.keyword_frequency(docs, lexicon).collect()}
    assert n == {("a", "x", "red", 2), ("a", "x", "ring", 2), ("a", "y", "bolt", 1), ("b", "x", "Red", 2)}
    stats = {(r.main, r.sub): (r.matched, r.unmatched, r.pct) for r in containment.category_stats(docs, lexicon).collect()}
    assert stats == {("a", "x"): (3, 2, 60.0), ("a", "y"): (1, 4, 20.0), ("b", "x"): (2, 3, 40.0), ("b", "z"): (0, 5, 0.0)}


def test_no_texts_and_no_keywords(spark):
    docs, lexicon = frames(spark, ["a"], [("m", "s", "a")])
    assert containment.held_keywords(docs.limit(0), lexicon).collect() == []
    assert containment.held_keywords(docs, lexicon.limit(0)).collect() == []
    assert containment.category_stats(docs.limit(0), lexicon).collect()[0].matched == 0


def test_rarest_gram_is_the_key(spark):
    _, lexicon = frames(spark, [], [("m", "s", w) for w in ("abcdefgh", "abcdefxy", "ABCDEFGH", "ab")])
    keys = {r.keyword: r.gram for r in containment.gram_keys(lexicon).collect()}
    assert keys["abcdefgh"] == keys["ABCDEFGH"] != "abcdef" and keys["ab"] == "ab"
    shared = containment.gram_keys(lexicon).groupBy("gram").agg(F.countDistinct("low").alias("n")).agg(F.max("n")).first()[0]
    assert shared == 1


def test_little_more_than_the_hits_leaves_the_tasks(spark):
    """Texts of 4,000 places each send the grams they hold, once a row, and not their places."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(4_000)) for _ in range(50)]
    words = [texts[k][100 * k : 100 * k + 14] for k in range(40)] + ["ab", "ha"]
    docs, lexicon = frames(spark, texts, [("m", "s", w) for w in words])
    keys = containment.gram_keys(lexicon)
    found = containment.text_grams(docs.selectExpr("ID AS id", "Content AS low"), keys).collect()
    want = {(k, w.encode()) for k, w in held(texts, [("m", "s", w) for w in words])}
    assert len(found) == len(set(found)) < len(want) + 100 and want <= {(r.id, bytes(r.gram)) for r in found}


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_long_keywords_and_rows_that_share_an_id(spark, monkeypatch, bound):
    """Keywords beyond a gram, rows of one id with different texts, and a row without an id: each row counts for itself."""
    monkeypatch.setattr("shelfvoice.operators.joins.BROADCAST_MAX_ROWS", bound)
    long = "Eine Überschrift, die länger als ein Gramm ist"
    texts = [(1, f"xx {long.upper()} yy {long}"), (1, "nur ein gramm"), (1, "nur ein gramm"), (None, f"{long} gramm"), (2, long[:-1]), (3, long[1:])]
    docs = spark.createDataFrame(texts, "ID long, Content string")
    entries = [("m", "s", long), ("m", "t", "gramm"), (None, "s", "nur")]
    lexicon = spark.createDataFrame(entries, "main string, sub string, keyword string")
    want = sorted((str(i), str(m), s, k) for i, t in texts for m, s, k in entries if k.lower() in t.lower())
    assert sorted((str(r.ID), str(r.main), r.sub, r.keyword) for r in containment.lexicon_pairs(docs, lexicon).collect()) == want
    counts = {(r.main, r.sub, r.keyword): r.n for r in containment.keyword_frequency(docs, lexicon).collect()}
    assert counts == {("m", "s", long): 2, ("m", "t", "gramm"): 6, (None, "s", "nur"): 2}


def test_frequency_counts_grams_before_they_meet_keywords(spark):
    """The only rows that the frequencies of short keywords move are counts, never pairs of a text and a keyword."""
    docs, lexicon = frames(spark, ["a b", "b"] * 50, [("m", "s", "a"), ("m", "t", "b")])
    made = containment.keyword_frequency(docs, lexicon)
    assert {tuple(r) for r in made.collect()} == {("m", "s", "a", 50), ("m", "t", "b", 100)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") < plan.index("MapInArrow")


def test_lengths_share_a_look_up_and_lose_nothing(spark, monkeypatch):
    """Keywords of every length in bytes up to 40, many of which begin alike, in rows longer and shorter than a stretch."""
    monkeypatch.setattr(containment, "STRETCH", 64)
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abé") for _ in range(rnd.choice([3, 30, 700]))) for _ in range(60)]
    entries = [("m", "s", texts[k][at : at + n]) for k in range(20) for n in range(1, 24) for at in (0, 9)] + [("m", "s", "ab" * k) for k in range(1, 12)]
    entries = [e for e in entries if e[2]]
    docs, lexicon = frames(spark, texts, entries)
    got = [(r.id, r.keyword) for r in containment.held_keywords(docs, lexicon).collect()]
    assert len(got) == len(set(got)) and set(got) == held(texts, entries)

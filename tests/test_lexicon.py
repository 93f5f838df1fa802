"""Tagging against brute force."""

import pytest

from shelfvoice.operators import lexicon as L


@pytest.fixture
def lexicon(spark):
    raw = L.lexicon_from_spec(
        spark, {"m": {"taste": "taste, bitter,100%, ,taste", "eat": "eat"}, "n": {"none": "zzqx", "case": "TASTE\nÉ"}}
    )
    return L.Lexicon.of(L.normalise_lexicon(raw))


def hits(df):
    return sorted((r.ID, r.sub, r.keyword) for r in df.collect())


def brute(reviews, lexicon):
    return sorted(
        (r.ID, s, k) for r in reviews.collect() for _, s, k in lexicon.entries if r.Content and k.lower() in r.Content.lower()
    )


def test_matching(processed, lexicon):
    want = brute(processed, lexicon)
    assert hits(L.lexicon_join(processed, lexicon)) == want
    assert (1, "eat", "eat") in want and (2, "taste", "100%") in want
    flags = {r.ID: r for r in L.category_flags(processed, lexicon).collect()}
    for i in range(1, 6):
        assert flags[i].is_m__taste == any(h[0] == i and h[1] == "taste" for h in want)
        assert flags[i].is_n__none is False
    stats = {r["sub"]: (r.matched, r.pct, r.unmatched) for r in L.category_stats(processed, lexicon).collect()}
    assert stats == {"taste": (4, 80.0, 1), "eat": (1, 20.0, 4), "none": (0, 0.0, 5), "case": (3, 60.0, 2)}
    freq = {(r["sub"], r.keyword): r.n for r in L.keyword_frequency(processed, lexicon).collect()}
    assert freq == {
        ("taste", "taste"): 3, ("taste", "bitter"): 1, ("taste", "100%"): 1, ("eat", "eat"): 1,
        ("case", "TASTE"): 3, ("case", "É"): 1,
    }
    matched = L.match_array(processed, lexicon.keywords)
    assert {r.ID: r.Matches for r in matched.collect()} == {
        i: sorted({h[2] for h in want if h[0] == i}) for i in range(1, 6)
    }
    assert {r.keyword: r.n for r in L.match_keyword_counts(matched).collect()}["taste"] == 3
    assert L.match_summary(matched).first().match_rate == 80.0


def test_empty_lexicon(processed, lexicon):
    none = L.Lexicon(())
    assert L.category_stats(processed, none).count() == 0
    assert L.keyword_frequency(processed, none).count() == 0
    assert L.category_flags(processed, none).count() == 5


def test_upkeep(spark):
    base = spark.createDataFrame([("m", "a", "x"), ("m", "b", "y")], "main string, sub string, keyword string")
    change = spark.createDataFrame([("m", "b", "z"), ("q", "c", "w")], "main string, sub string, keyword string")
    got = sorted(tuple(r) for r in L.upsert_categories(base, change).collect())
    assert got == [("m", "a", "x"), ("m", "b", "z"), ("q", "c", "w")]
    assert L.delete_categories(base, spark.createDataFrame([("m",)], "main string")).count() == 0


def test_ranking_orders(processed, lexicon):
    stats = L.category_stats(processed, lexicon)
    assert [r["sub"] for r in L.category_ranking(stats).collect()] == ["taste", "case", "eat", "none"]
    assert [r["sub"] for r in L.category_ranking(stats, "matched", False).collect()] == ["none", "eat", "case", "taste"]
    assert [r["sub"] for r in L.category_ranking(stats, "name").collect()] == ["none", "case", "taste", "eat"]
    assert [r["sub"] for r in L.top_categories(stats, 2).collect()] == ["taste", "case"]


def test_clashing_names_stay_apart(processed):
    names = [("m", "a b"), ("m", "a.b"), ("m", "A`b"), ("a__b", "c"), ("a", "b__c"), ("Pain", "x"), ("pain", "x")]
    words = ["taste", "bitter", "easy", "great", "zzqx", "not", "swallow"]
    lexicon = L.Lexicon(tuple((m, s, k) for (m, s), k in zip(names, words)))
    columns = L.flag_names(lexicon.categories)
    assert len({c.lower() for c in columns.values()}) == len(names)
    want = {n: {r.ID for r in processed.collect() if r.Content and k in r.Content.lower()} for n, k in zip(names, words)}
    flagged = L.category_flags(processed, lexicon)
    assert {n: {r.ID for r in flagged.collect() if r[columns[n]]} for n in names} == want
    assert {(r.main, r["sub"]): r.matched for r in L.category_stats(processed, lexicon).collect()} == {n: len(w) for n, w in want.items()}
    for name in names:
        assert {r.ID for r in L.flag_filter(flagged, *name, lexicon).collect()} == want[name]
    with pytest.raises(ValueError, match="names of flags"):
        L.add_flags(flagged, lexicon)


@pytest.mark.parametrize("more", [0, 60])
def test_blank_keywords_match_nothing_at_any_size(processed, more):
    keywords = ["taste", "", " "] + [f"none{k}" for k in range(more)]
    got = {r.ID: r.Matches for r in L.match_array(processed, keywords).collect()}
    assert got == {1: ["taste"], 2: [], 3: [], 4: ["taste"], 5: ["taste"]}


def test_a_lexicon_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_KEYWORDS", 2)
    table = spark.createDataFrame([("m", "a", str(k)) for k in range(3)], "main string, sub string, keyword string")
    with pytest.raises(ValueError, match="lexicon of more"):
        L.Lexicon.of(table)

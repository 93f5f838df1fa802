import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from shelfvoice.llm import collocations
from tests.llm.helpers import ROWS, empty, table

LOWER = str.maketrans({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


def counted(rows):
    """Counts of phrases of one to three words by language, by the definition."""
    counts = {}
    for text, lang in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                f.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return counts


def expected(rows, top, least, cover=50):
    out = set()
    for lang, f in counted(rows).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in cands.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    held[part] = max(held[part], a)
        made = []
        for p, a in cands.items():
            s, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not (len(p) == 2 and held[p] and 100 * held[p] >= cover * a):
                made.append((-s, -a, " ".join(p).encode(), l, r))
        made.sort()
        out |= {(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(made[:top], 1)}
    return out


def corpus(seed, texts=60):
    rnd = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "A", "b", "ö", "x1", " ", "日本"] + [f"w{k}" for k in range(30)]
    rows = []
    for _ in range(texts):
        w = []
        for _ in range(rnd.randrange(0, 60)):
            w += rnd.choice([["new", "York", "city"], ["of", "the"], ["a", "B"], [rnd.choice(words)], [rnd.choice(words)]])
        text = "".join(x + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " ! "]) for x in w)
        rows.append((text, rnd.choice(["en", "en", "en", None, "und", "de"])))
    return rows


@pytest.mark.parametrize("seed,top,least,cover", [(1, 5, 2, 50), (2, 40, 3, 50), (3, 1000, 2, 90), (4, 3, 4, 5)])
def test_phrases_by_brute_force(spark, seed, top, least, cover):
    rows = corpus(seed)
    docs = table(spark, [(k, t, lang, "s", 0) for k, (t, lang) in enumerate(rows)])
    found = collocations.collocations(docs, top=top, least=least, cover=cover).collect()
    assert {tuple(r) for r in found} == expected(rows, top, least, cover) and len(found) > 5


def test_the_level_falls_until_enough_survive(spark, monkeypatch):
    """The best pairs all lie in longer phrases, so the first expansion settles none."""
    monkeypatch.setattr(collocations, "FIRST_SHARE", 1)
    monkeypatch.setattr(collocations, "WIDEN", 2)
    text = ". ".join(f"p{k} q{k} r{k}" for k in range(12)) + ". " + ". ".join(f"c d{k}. c d{k}" for k in range(9))
    rows = [(text, "en")] * 3
    docs = table(spark, [(k, t, lang, "s", 0) for k, (t, lang) in enumerate(rows)])
    assert {tuple(r) for r in collocations.collocations(docs, top=15, least=3).collect()} == expected(rows, 15, 3)


def test_odd_rows(spark):
    assert collocations.collocations(empty(spark)).collect() == []
    found = collocations.collocations(table(spark), least=2).collect()
    assert {tuple(r) for r in found} == expected([(r[1], r[2]) for r in ROWS], 2000, 2)


def test_chunks_cut_no_phrase(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 7)
    rows = corpus(9, 20)
    batch = pa.RecordBatch.from_arrays([pa.array([lang for _, lang in rows]), pa.array([t for t, _ in rows])], ["lang", "text"])
    got = {}
    for made in collocations._count_short([batch]):
        for lang, words, phrase, f in zip(*(c.to_pylist() for c in made.columns)):
            if words:
                got[lang, phrase] = got.get((lang, phrase), 0) + f
    want = {(lang, " ".join(p)): n for lang, f in counted(rows).items() for p, n in f.items() if len(p) < 3}
    assert got == want

    class Full:
        value = bytes([255]) * (1 << (collocations.FRONTIER_BITS - 3))

    got = {}
    for made in collocations._count_grown(Full, Full)([batch]):
        for lang, _, phrase, f in zip(*(c.to_pylist() for c in made.columns)):
            got[lang, phrase] = got.get((lang, phrase), 0) + f
    assert got == {(lang, " ".join(p)): n for lang, f in counted(rows).items() for p, n in f.items() if len(p) == 3}


def test_scores_beyond_64_bits(spark):
    cases = [(10**13, 10**13, 10**13 + 7), (7_777_777_777_777, 8_888_888_888_881, 9_999_999_999_971), (10, 10, 10), (10, 10**14, 10**14)]
    rows = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocations.score("a", "l", "r").alias("s"), collocations._bound("a", "l").alias("b")).collect()
    for r in rows:
        assert r.s == 1_000_000 * r.a * r.a // (r.l * r.r) and r.b == 1_000_000 * r.a // r.l


def test_bitmap_holds_the_pairs(spark):
    import xxhash

    pairs = [("en", f"a{k}", f"ü{k * 7}") for k in range(500)]
    bits = collocations._bitmap(spark.createDataFrame(pairs, "lang string, w1 string, w2 string"))
    for pair in pairs:
        h = xxhash.xxh64_intdigest(" ".join(pair).encode(), 42) & ((1 << collocations.FRONTIER_BITS) - 1)
        assert bits[h >> 3] >> (h & 7) & 1
    assert sum(b.bit_count() for b in bits) <= 500


def _summed(made):
    got = {}
    for rows in made:
        for lang, words, phrase, f in zip(*(c.to_pylist() for c in rows.columns)):
            if words:
                got[lang, phrase] = got.get((lang, phrase), 0) + f
    return got


class _All:
    value = bytes([255]) * (1 << (collocations.FRONTIER_BITS - 3))


@pytest.mark.parametrize("entries,words,remembered", [(3_000_000, 5, 19), (40, 400_000, 2), (7, 6, 1)])
def test_words_numbered_anew_lose_no_phrase(monkeypatch, entries, words, remembered):
    """Counts sent on, words numbered anew and pairs forgotten in the midst of texts, and texts without a blank."""
    for name, value in (("MAX_ENTRIES", entries), ("MAX_WORDS", words), ("REMEMBERED_BITS", remembered), ("CHUNK", 30)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(11, 40) + [("\n".join(f"u{k}\tv{k % 7}" for k in range(300)), "en"), (".".join(f"x{k % 50}" for k in range(400)), None)]
    batches = [pa.RecordBatch.from_arrays([pa.array([lang for _, lang in part]), pa.array([t for t, _ in part])], ["lang", "text"]) for part in (rows[:20], rows[20:])]
    want = {(lang, " ".join(p)): (len(p), n) for lang, f in counted(rows).items() for p, n in f.items()}
    assert _summed(collocations._count_short(batches)) == {k: n for k, (size, n) in want.items() if size < 3}
    assert _summed(collocations._count_grown(_All, _All)(batches)) == {k: n for k, (size, n) in want.items() if size == 3}


def test_a_task_sends_each_phrase_once():
    """A task of a million places and half as many phrases: what it sends is not the same pair again and again."""
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(700)}" for _ in range(10_000)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    sent = sum(rows.num_rows for rows in collocations._count_short([batch]))
    assert sent == sum(len(f) for f in [{(a, b) for t in texts for w in [t.split()] for a, b in zip(w, w[1:])}]) + 700 + 1

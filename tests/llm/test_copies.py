import hashlib
import random

import numpy as np
import pytest

from shelfvoice.llm import components, decontaminate, fingerprints, simhash_trie
from tests.llm.helpers import ROWS, empty, table


def union(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        p[find(a)] = find(b)
    return [find(k) for k in range(n)]


def test_fingerprint_by_its_definition():
    import xxhash

    text = "A b\tC d A b  c"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash_trie.text_fingerprint(text) == want
    assert simhash_trie.text_fingerprint("A\nB") == xxhash.xxh64_intdigest("a b", 42)
    assert simhash_trie.text_fingerprint(None) == simhash_trie.text_fingerprint(" \t") == 0


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_trie_finds_all_pairs(radius):
    rnd = np.random.default_rng(radius)
    centres = rnd.integers(0, 2**63, 20, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(15):
            prints.add(int(c) ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 7), replace=False)))
    fps = np.array(sorted(prints), dtype=np.uint64)
    got = {(int(a), int(b)) for i, j in simhash_trie.trie_pairs(fps, np.array([0, len(fps)]), radius) for a, b in zip(i, j)}
    got = {tuple(sorted(x)) for x in got}
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize(("radius", "exact", "rows"), [(2, 1, 200_000), (2, 1, 10), (3, 2, 200_000), (6, 2, 200_000), (6, 3, 30)])
def test_groups_by_brute_force(spark, radius, exact, rows):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(60)]
        for _ in range(rnd.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                own[rnd.randrange(60)] = rnd.choice(words)
            texts.append(" ".join(own))
    texts += [None, "", "  ", "x", "x"]
    docs = table(spark, [(k * 3, t, "en", "s", 0) for k, t in enumerate(texts)])
    fps = [simhash_trie.text_fingerprint(t) for t in texts]
    group = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius])
    least = {}
    for k, g in enumerate(group):
        least.setdefault(g, k * 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_trie.near_groups(docs, radius=radius, exact=exact, trie_rows=rows).collect()}
    assert got == {k * 3: (f"{f:016x}", least[group[k]]) for k, f in enumerate(fps)}


def test_group_edge_cases(spark):
    got = simhash_trie.near_groups(table(spark)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by[1][0] == by[2][0] and by[1][0][1] == 1
    assert {by[k][0] for k in (3, 4, 6)} == {("0" * 16, 3)}
    assert len(by[7]) == 2 and by[None][0][1] is None
    assert simhash_trie.near_groups(empty(spark)).collect() == []


def test_one_of_each_keeps_rows_and_columns(spark):
    docs = table(spark)
    kept = simhash_trie.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "5", "7", "8", "None"])
    assert simhash_trie.one_of_each(empty(spark)).collect() == []


def test_pairs_of_many_equal_prints(monkeypatch):
    monkeypatch.setattr(simhash_trie, "_PAIRS", 50)
    fps = np.array([5] * 30 + [7] * 20 + [2**60] * 3, dtype=np.uint64)
    got = [(int(a), int(b)) for i, j in simhash_trie.trie_pairs(fps, np.array([0, len(fps)]), 1) for a, b in zip(i, j)]
    assert sorted(got) == [(a, b) for a in range(53) for b in range(a + 1, 53) if int(fps[a] ^ fps[b]).bit_count() <= 1]


def test_components_of_chains_and_hubs(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(500, k) for k in range(501, 560)] + [(rnd.randrange(900, 960), rnd.randrange(900, 960)) for _ in range(50)] + [(None, 3), (7, 7)]
    want = union(1000, [e for e in edges if None not in e])
    least = {}
    for k, g in enumerate(want):
        least.setdefault(g, k)
    ends = {v for e in edges if None not in e and e[0] != e[1] for v in e}
    frame = spark.createDataFrame(edges, "u long, v long")
    for bound in (2_000_000, 10):
        monkeypatch.setattr(components, "BROADCAST_MAX_ROWS", bound)
        got = {r.vertex: r.root for r in components.components(frame).collect()}
        assert got == {v: least[want[v]] for v in ends}
    assert components.components(frame.filter("u = -1")).collect() == []


def grams(words):
    return decontaminate.shingle_hashes(decontaminate.word_hashes(words), 5)


def test_leaks_by_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([12, 15, 22, 40])))) for k in range(12)]
    items += [(50, "two words"), (51, None), (52, ""), (0, items[0][1])]
    docs = []
    for k in range(60):
        own = [rnd.choice(words) for _ in range(rnd.choice([0, 5, 80, 200]))]
        if k % 3 == 0:
            at, held = rnd.randrange(len(own) + 1), rnd.choice(items)[1] or ""
            own[at:at] = held.upper().split()
        docs.append((k, " ".join(own), "en", "s", 0))
    docs += [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, "Two... words!", "en", "s", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, docs), bench).collect()}
    want = set()
    for doc, text, *_ in docs:
        w = decontaminate.WORD.findall((text or "").lower())
        for item, held in set(items):
            h = decontaminate.WORD.findall((held or "").lower())
            for a in range(len(w) - len(h) + 1) if h else ():
                part = w[a : a + len(h)]
                if part == h or len(h) >= 5 and decontaminate.similarity(grams(part), grams(h)) >= 0.95:
                    want.add((doc, item))
    assert want <= got
    for doc, item in got - want:  # nearer than the bound, though not equal
        w, h = decontaminate.WORD.findall(docs[doc][1].lower()), decontaminate.WORD.findall(dict(items)[item].lower())
        assert max(decontaminate.similarity(grams(w[a : a + len(h)]), grams(h)) for a in range(len(w) - len(h) + 1)) >= 0.8
    clean = decontaminate.clean(table(spark, docs), bench)
    assert {r.doc_id for r in clean.collect()} == {d[0] for d in docs} - {d for d, _ in got}


def test_multi_index_returns_all_within_radius():
    rnd = np.random.default_rng(4)
    items = [(k, rnd.integers(0, 2**63, 30, dtype=np.uint64)) for k in range(20)]
    probes = decontaminate.Probes(5, 30, items)
    near = [int(p) ^ sum(1 << int(b) for b in rnd.choice(64, d, replace=False)) for p in probes.print for d in (0, 3, 11, 12)]
    prints = np.array(near, dtype=np.uint64)
    at, who, d = probes.search(prints)
    want = {(a, b, int(x)) for a in range(len(prints)) for b in range(len(probes.print)) if (x := int(np.bitwise_count(prints[a] ^ probes.print[b]))) <= decontaminate.RADIUS}
    assert set(zip(at.tolist(), who.tolist(), d.tolist())) == want


def test_leak_edge_cases(spark):
    bench = spark.createDataFrame([(1, ROWS[0][1])], "item_id long, text string")
    got = decontaminate.leaks(table(spark), bench).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words, r.similarity) for r in got) == [(1, 0, 18, 1.0), (2, 0, 18, 1.0)]
    assert decontaminate.leaks(empty(spark), bench).collect() == []
    assert decontaminate.leaks(table(spark), bench.filter("item_id = 2")).collect() == []


def test_compare_edited_by_its_definition(spark):
    rows = [r for r in ROWS if r[0] not in (None, 7)]
    got = {r.doc_id: r for r in fingerprints.compare_edited(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    texts = [(r[0], r[1] or "") for r in sorted(rows)]
    for k, (doc, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    assert fingerprints.compare_edited(empty(spark)).collect() == []


def test_repeated_and_null_ids_follow_each_other(spark):
    got = fingerprints.with_next(table(spark)).filter("NOT ghost").select("doc_id", "text", "next_text").collect()
    order = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted((str(d), t, order[(k + 1) % len(order)][1]) for k, (d, t) in enumerate(order))
    assert sorted((str(a), b, c) for a, b, c in got) == want


def test_sketches_merge_and_contain(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    long = [rnd.choice(words) for _ in range(4000)]
    pairs = [(" ".join(long), " ".join(long[1000:1400])), ("a b c d e f", "a b c d e f g"), ("", "x y"), (" ".join(long[:2000]), " ".join(long[1000:3000]))]
    frame = spark.createDataFrame(pairs, "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    got = frame.select(fingerprints.containment(b, a).alias("c"), fingerprints.likeness(a, b).alias("j")).collect()
    assert got[0].c == 1.0 and abs(got[0].j - 0.1) < 0.05
    assert got[1].c == pytest.approx(2 / 3) and got[2].j == 0.0
    assert abs(got[3].j - 1 / 3) < 0.08
    both = spark.createDataFrame([(" ".join(long[:2000]), " ".join(long[1996:]), " ".join(long))], "a string, b string, c string")
    row = both.select(fingerprints.merge(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("m"), fingerprints.sketch(F.col("c")).alias("s")).first()
    assert row.m == row.s

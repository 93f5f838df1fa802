import numpy as np
import pytest

from shelfvoice.llm import small_world
from shelfvoice.llm.common import table


def brute(vectors, queries, most=20):
    """The nearest rows of each query by the definition; vectors: id to list."""
    out = {}
    for q in queries:
        made = []
        for k, v in vectors.items():
            if k != q and len(v) == len(vectors[q]):
                made.append((-sum(a * b for a, b in zip(v, vectors[q])), k))
        out[q] = sorted(made)[:most]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string, size string, score string, label int")


def test_recall_on_the_given_table(spark):
    """Every query and rank is there, scores are those of the original vectors, and at least nine tenths are found."""
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    found = small_world.search_table(rows, shard_rows=1500).cache()
    vectors = small_world.usable(rows).cache()
    true = small_world.exact(vectors, vectors.filter("vec_id % 20 = 0"), parts=8)
    assert small_world.recall(found, true) >= 0.95
    by = {r.vec_id: np.array(r.vector) for r in vectors.collect()}
    got = {}
    for r in found.collect():
        assert r.score == pytest.approx(float(by[r.query_id] @ by[r.vec_id]), abs=1e-12) and r.query_id != r.vec_id
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert set(got) == {k for k in by if k % 20 == 0}
    for hits in got.values():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21)) and hits == sorted(hits, key=lambda h: h[1:])


def test_small_tables_by_brute_force(spark):
    """Small shards are searched whole: lengths that differ, copies, ties, repeated ids, left out rows."""
    rnd = np.random.default_rng(3)
    vectors = {k: (rnd.integers(-3, 4, 5) * rnd.choice([1, 100])).astype(float).tolist() for k in range(150)}
    vectors |= {k: [1.0, 0.0, 2.0, 0.0, 0.0] for k in range(150, 260)} | {k: [2.0, 3.0] for k in range(260, 264)} | {-20: [0.5] * 5}
    vectors = {k: v for k, v in vectors.items() if any(v)}
    rows = [(k, v, "s", "z", "c", 1) for k, v in vectors.items()]
    rows += [(20, [99.0] * 5, "repeated, not the least", None, None, 1), (rows[3][0], rows[3][1], None, None, None, 2)] * 2
    vectors[20] = min(vectors.get(20, [99.0] * 5), [99.0] * 5)
    rows += [(1000, None, "s", "z", "c", 1), (1020, [0.0] * 5, "", "", "", 0), (1040, [1.0, None, 0.0, 0.0, 0.0], "", "", "", 0), (1060, [float("nan")] * 5, "", "", "", 0)]
    rows += [(1080, [float("inf"), 1.0, 1.0, 1.0, 1.0], "", "", "", 0), (None, [1.0] * 5, "", "", "", 0), (1100, [], "", "", "", 0)]
    want = brute(vectors, [k for k in vectors if k % 20 == 0])
    got = {}
    for r in small_world.search_table(frame(spark, rows), shard_rows=60).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == want
    assert len(want[260]) == 3


def test_blocks_of_queries_meet_every_shard(spark):
    rnd = np.random.default_rng(5)
    vectors = {k: rnd.normal(size=4).astype(np.float32).tolist() for k in range(300)}
    usable = small_world.usable(frame(spark, [(k, v, "", "", "", 0) for k, v in vectors.items()]))
    shards = small_world.stage(small_world.index(usable, 64), "shards")
    got = small_world.neighbours(shards, usable.filter("vec_id % 3 = 0"), 7, block=20).collect()
    want = brute(vectors, range(0, 300, 3), 7)
    assert {(r.query_id, r.rank): r.vec_id for r in got} == {(q, k): x[1] for q, hits in want.items() for k, x in enumerate(hits, 1)}


def test_no_rows(spark):
    assert small_world.search_table(frame(spark, [])).collect() == []
    assert small_world.search_table(frame(spark, [(20, [1.0], "", "", "", 0)])).collect() == []


def test_graph_finds_the_nearest_of_a_hard_set():
    """Independent normal vectors whose lengths differ, and a third of the nodes close together."""
    rnd = np.random.default_rng(11)
    vectors = rnd.normal(size=(4000, 24)) * rnd.uniform(0.2, 3, (4000, 1))
    vectors[::3] = vectors[0] + rnd.normal(size=(1334, 24)) * 1e-3
    vectors = vectors[rnd.permutation(4000)]
    levels = small_world.build(small_world._equal_lengths(vectors))
    assert [len(x) for x in levels] == [4000, 250, 15] and all(x.max() < len(x) and x.dtype == np.int32 for x in levels)
    queries = rnd.normal(size=(200, 24))
    asked = np.column_stack((queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(200))).astype(np.float32)
    reached = small_world.search(levels, small_world._equal_lengths(vectors), asked)
    true = np.argsort(-(queries @ vectors.T), axis=1)[:, :20]
    assert np.mean([len({*a} & {*b}) / 20 for a, b in zip(true, reached)]) >= 0.9

import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfvoice.llm import best_fit, packing, presplit, token_counts, token_ids
from shelfvoice.llm.common import tokenizer_path
from tests.llm.helpers import ROWS, empty, table

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aests'rvledmtLl  \n\t 12é!?.Ω中", max_size=600), max_size=4))
def test_pieces_are_those_of_the_pattern(texts):
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    assert presplit.pieces(texts) == [pattern.findall(t) for t in texts]


def test_pieces_across_chunk_ends():
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [c * n + s for c in "a '\n!1" for n in range(250, 262) for s in ("'re", "'rx", "  b", "'l", "'ll x")]
    assert presplit.pieces(texts) == [pattern.findall(t) for t in texts]


def test_scan_composes_within_runs():
    rnd = np.random.default_rng(1)
    maps, first = rnd.integers(0, 12, (70, 12)).astype(np.uint8), rnd.random(70) < 0.1
    first[0] = True
    got, want = presplit.scan(maps, first), maps.copy()
    for k in range(1, 70):
        if not first[k]:
            want[k] = maps[k][want[k - 1]]
    assert (got == want).all()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="theinganr ", max_size=60) | st.text(alphabet="<|endoftx>a ", max_size=40))
def test_counts_and_ids_are_the_library_s(text):
    ids = expected(text)
    assert token_counts.count_tokens([text], PATH) == [len(ids)]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in token_ids.encode([text], PATH)] == [ids]


def test_workers_forget_and_go_on(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 5)
    monkeypatch.setattr(token_counts, "MAX_PIECES", 3)
    monkeypatch.setattr(token_ids, "MAX_PIECES", 3)
    text = "many different words stand here, and there are more of them"
    assert token_counts.Counter(PATH).machine.count(text.encode()) > 0
    count = token_counts.Counter(PATH)
    assert sum(count[p] for p in presplit.pieces([text])[0]) == len(expected(text))
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in token_ids.encode([text], PATH)] == [expected(text)]


def test_token_counts_table(spark):
    got = token_counts.token_counts(table(spark), PATH).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(expected(r[1])), len(expected(r[1])) > 512) for r in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(empty(spark), PATH).collect() == []


def check_packed(rows, docs, capacity):
    left = collections.Counter()
    for doc, text in docs:
        ids = expected(text) + [0]
        for k, (s, n) in enumerate(token_ids.cut(len(ids), capacity)):
            left[doc, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())] += 1
    assert left == collections.Counter(tuple(r)[:5] for r in rows)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pack_table(spark, capacity):
    got = best_fit.pack(table(spark), PATH, capacity=capacity).collect()
    n = check_packed(got, [(r[0], r[1]) for r in ROWS], capacity)
    total = sum(r.length for r in got)
    assert n - 1 <= -(-total // capacity)
    assert best_fit.pack(empty(spark), PATH).collect() == []


def test_pack_one_length_holds_most_rows(spark):
    rows = [(k, "one" if k % 3 else f"row number {k}", "en", "s", 0) for k in range(600)]
    got = best_fit.pack(table(spark, rows), PATH, capacity=7).collect()
    check_packed(got, [(r[0], r[1]) for r in rows], 7)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=12))
def test_plan_is_best_fit_on_documents(counts):
    slots, made = best_fit.plan(counts, 64)
    seen, used = collections.Counter(), collections.defaultdict(list)
    for length, rank, n, sequence, offset in slots:
        assert rank == seen[length]
        seen[length] += n
        for k in range(n):
            used[sequence + k].append((offset, length))
    assert seen == collections.Counter(counts) and len(used) == made
    rooms = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((64 if fit is None else fit) - length)
    assert len(rooms) == made
    assert sorted(64 - sum(n for _, n in own) for own in used.values()) == sorted(rooms)


def test_room_tree_and_task_packing():
    rnd = random.Random(2)
    lengths = np.array([rnd.randint(1, 100) for _ in range(500)])
    rows = packing.best_fit(lengths, 100)
    assert sorted(k for own in rows for k in own) == list(range(500))
    assert all(lengths[own].sum() <= 100 for own in rows)
    rooms = []
    for length in sorted(lengths.tolist(), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((100 if fit is None else fit) - length)
    assert len(rooms) == len(rows)


def test_packed_matrices_round_trip(spark, tmp_path):
    made = packing.packed_matrices(table(spark), PATH, capacity=256)
    packing.write_packed(made, str(tmp_path / "out"))
    parts = collections.defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        ids, spots = np.frombuffer(r.ids, dtype="<u4"), np.frombuffer(r.position_ids, dtype="<u2")
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for k, (doc, piece, start) in enumerate(zip(r.doc_ids, r.pieces, r.starts)):
            a, b = r.cu_seqlens[k : k + 2]
            assert spots[a:b].tolist() == list(range(b - a))
            parts[doc].append((piece, start, ids[a:b].tolist()))
    for doc, text in {(r[0], r[1]) for r in ROWS}:
        n = sum(r[0] == doc for r in ROWS)
        own = sorted(parts[doc])
        assert [x for _, _, ids in own for x in ids] == [x for piece in _cut(expected(text) + [0], 256) for _ in range(n) for x in piece]
    assert packing.packed_matrices(empty(spark), PATH).collect() == []


def _cut(ids, most):
    return [ids[s : s + n] for s, n in token_ids.cut(len(ids), most)]

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfvoice.llm import alignment
from shelfvoice.llm.common import table as given_table
from shelfvoice.llm.common import tokenizer_path
from shelfvoice.llm.token_counts import byte_alphabet
from tests.llm.helpers import ROWS, empty, table

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A_PATH, B_PATH = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
A = tokenizers.Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
ALPHABET = byte_alphabet()


def tokens(text):
    """Ids and bytes of both by whole-text calls of the libraries."""
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(ALPHABET[c] for c in A.id_to_token(i)) for i in a]
    pieces = [B.id_to_piece(i) for i in b]
    return a, a_bytes, b, [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]


def one(text):
    """``(links, n_a, n_b, groups)`` by looking at all token pairs near each other."""
    if not text:
        return [], 0, 0, []
    a, a_bytes, b, b_bytes = tokens(text)
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return [], 0, 0, []
    spans = []
    for ids, parts in ((a, a_bytes), (b, b_bytes)):
        at, made = 0, []
        for i, p in zip(ids, parts):
            made.append((at, at + len(p), i))
            at += len(p)
        spans.append(made)
    links, k = [], 0
    for lo, hi, i in spans[0]:
        while spans[1][k][1] <= lo:
            k += 1
        j = k
        while j < len(spans[1]) and spans[1][j][0] < hi:
            links.append((i, spans[1][j][2]))
            j += 1
    groups, x, y = [], [], []
    ends = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
    for end in sorted(ends):
        start = groups[-1][0] if groups else 0
        groups.append((end, [i for lo, hi, i in spans[0] if start <= lo and hi <= end], [i for lo, hi, i in spans[1] if start <= lo and hi <= end]))
    return links, len(a), len(b), [(x, y) for _, x, y in groups]


def expected(texts):
    made = [one(t or "") for t in texts]
    count = Counter(p for links, *_ in made for p in set(links))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for links, n_a, n_b, groups in made:
        named = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(named.encode()).hexdigest() if n_a else ""))
    return out


@settings(max_examples=250, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab'sre 12  \n\t.é▁᠎　<|endoftext|>", max_size=50))
def test_one_text_is_the_libraries_alignment(text):
    links, n_a, n_b, groups = one(text)
    rows, digests, pairs, times, bounds = alignment.aligner(A_PATH, B_PATH).texts([text, "x"])
    assert rows[0].tolist() == [n_a, n_b, len(groups), len(links)]
    got = dict(zip(pairs[: bounds[1]].tolist(), times[: bounds[1]].tolist()))
    assert got == Counter(a << 32 | b for a, b in links)
    assert digests[0] == (hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if n_a else "")


def test_pieces_never_go_over_blanks():
    assert not alignment.aligner(A_PATH, B_PATH).whole


def measures(df):
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect()]


def test_given_documents_by_brute_force(spark):
    docs = given_table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text").collect()
    assert dict(measures(alignment.align(docs, A_PATH, B_PATH))) == dict(zip([r.doc_id for r in rows], expected([r.text for r in rows])))


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_odd_rows(spark, monkeypatch, bound):
    """Also with lookups that no broadcast may serve."""
    monkeypatch.setattr("shelfvoice.operators.joins.BROADCAST_MAX_ROWS", bound)
    rows = [r if r[0] != 5 else (5, r[1][:9000], *r[2:]) for r in ROWS]
    rows += [(100 + k, t, "en", "s", 0) for k, t in enumerate(["  two  blanks ", "a▁b", "tab\tand\n\nlines", "one", "�̀x", " ", "x" * 3000])]
    got = measures(alignment.align(table(spark, rows), A_PATH, B_PATH))
    assert sorted(got, key=str) == sorted(zip([r[0] for r in rows], expected([r[1] for r in rows])), key=str)
    assert alignment.align(empty(spark), A_PATH, B_PATH).collect() == []


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "MAX_STRETCHES", 3)
    known = alignment.Aligner(A_PATH, B_PATH)
    for text in ("a b c d e f", "g h", "a b g h i", "c"):
        rows, *_ = known.texts([text])
        links, n_a, n_b, groups = one(text)
        assert rows[0].tolist() == [n_a, n_b, len(groups), len(links)]

"""Token counts of a byte-level merge tokenizer by a finite-state transducer.

The split machine of ``presplit`` cuts texts into pieces. Inside a piece the
merges are compiled to a deterministic transducer over bytes whose transitions
carry the number of tokens they emit. It rests on a property of merge
tokenizers: the tokens of a prefix are fixed by its last token, which is the one
vocabulary entry ending there that may follow the last token of what stands
before it. A state therefore holds, for every position from which some entry
can still grow, the place in the vocabulary's prefix tree, the last token there,
and the count relative to now. States are made when they are first reached.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, ship
from shelfvoice.llm.presplit import grouped, pieces

#: Bounds of what a worker remembers; on reaching one it forgets and goes on.
MAX_STATES = 60_000
MAX_PIECES = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Merges:
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        decode = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"] for t in spec["added_tokens"]}
        ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.token = {i: decode(t) for t, i in ids.items()}
        self.single = {self.token[i]: i for t, i in ids.items() if len(t) == 1}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        self.tree: list[dict[int, int]] = [{}]  # prefix tree: byte to node
        self.ends: list[int] = [-1]  # node to token
        for i, raw in self.token.items():
            if self.encode(raw) != [i]:
                continue  # never comes out of the merges
            node = 0
            for byte in raw:
                step = self.tree[node].get(byte)
                if step is None:
                    step = self.tree[node][byte] = len(self.tree)
                    self.tree.append({})
                    self.ends.append(-1)
                node = step
            self.ends[node] = i
        self.fits = lru_cache(400_000)(self._fits)

    def encode(self, raw: bytes) -> list[int]:
        """Apply the merges in rank order."""
        ids = [self.single[raw[k : k + 1]] for k in range(len(raw))]
        while len(ids) > 1:
            ranked = [(self.merge.get(p, (1 << 60, -1)), k) for k, p in enumerate(zip(ids, ids[1:]))]
            (rank, made), at = min(ranked)
            if made < 0:
                break
            ids[at : at + 2] = [made]
        return ids

    def _fits(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left``? Only if their bytes together give just these two."""
        return self.encode(self.token[left] + self.token[right]) == [left, right]


class Transducer:
    """Deterministic, over bytes; ``count`` is the sum of what its transitions emit."""

    def __init__(self, merges: Merges):
        self.m = merges
        self._clear()

    def _clear(self) -> None:
        # Entry of a state: (tree node, last token there or -1 at the start, count there less the count now).
        first = ((0, -1, 0),)
        self.names = {first: 0}
        self.states = [first]
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def _build(self, state: int, byte: int) -> tuple[int, int]:
        tree, ends, fits = self.m.tree, self.m.ends, self.m.fits
        grown, last, emitted = [], -1, 0
        for node, before, less in self.states[state]:
            step = tree[node].get(byte)
            if step is None:
                continue
            end = ends[step]
            if end >= 0 and last < 0 and (before < 0 or fits(before, end)):
                last, emitted = end, less + 1
            if tree[step]:
                grown.append((step, before, less))
        key = (*((n, b, c - emitted) for n, b, c in grown), (0, last, 0))
        to = self.names.get(key)
        if to is None:
            to = self.names[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        self.next[state][byte] = to, emitted
        return to, emitted

    def count(self, raw: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self._clear()
        state = total = 0
        for byte in raw:
            step = self.next[state].get(byte)
            state, emitted = step if step is not None else self._build(state, byte)
            total += emitted
        return total


class Counter(dict):
    """Piece to count; a missing piece runs through the transducer."""

    def __init__(self, path: str):
        super().__init__()
        self.machine = Transducer(Merges(path))

    def __missing__(self, piece: str) -> int:
        if len(self) >= MAX_PIECES:
            self.clear()
        n = self[piece] = self.machine.count(piece.encode("utf-8"))
        return n


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def split_special(texts: list[str], special: set[str]) -> tuple[list[str], list[int], np.ndarray]:
    """Texts cut at special strings, the index of each part's text, and the number of such strings in each text."""
    parts, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        own = [t]
        for s in special:
            if s in t:
                own = [x for part in own for x in part.split(s)]
        extra[k] = len(own) - 1
        parts += own
        owner += [k] * len(own)
    return parts, owner, extra


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the tokenizer of the file gives them; its special strings are one token each."""
    count = counter(path)
    out: list[int] = []
    for a, b in grouped(texts):
        parts, owner, total = split_special(texts[a:b], count.machine.m.special)
        for k, found in zip(owner, pieces(parts)):
            total[k] += sum(map(count.__getitem__, found))
        out += total.tolist()
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    A null or empty text has no bytes and no tokens. Ids pass through, null and
    repeated ones too; other columns are not read; an empty table gives an empty
    one. One narrow pass, no shuffle. ``path`` is a byte-level merge tokenizer
    in JSON and must be readable by every executor.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(count_tokens(texts, path), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    text = col(text_col).cast("string")
    source = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

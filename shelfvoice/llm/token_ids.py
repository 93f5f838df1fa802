"""Token ids of whole texts: the library encodes each distinct piece once, the split machine does the rest."""

from __future__ import annotations

import os
import sys
from array import array
from functools import lru_cache

import numpy as np

from shelfvoice.llm.presplit import grouped, pieces
from shelfvoice.llm.token_counts import split_special

#: Pieces a worker remembers; beyond it forgets and goes on.
MAX_PIECES = 600_000


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    packed = array("I", ids)
    if packed.itemsize != 4 or sys.byteorder != "little":
        return np.array(ids, dtype="<u4").tobytes()
    return packed.tobytes()


class Encoder(dict):
    """Piece to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.special = {t.content: pack_ids([i]) for i, t in self.library.get_added_tokens_decoder().items()}

    def learn(self, found: set[str]) -> None:
        new = [p for p in found if p not in self]
        if len(self) + len(new) > MAX_PIECES:
            self.clear()
            new = list(found)
        for piece, made in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            self[piece] = pack_ids(made.ids)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(texts: list[str], path: str):
    """Yield each text's ids as bytes, in order."""
    ids = encoder(path)
    if len(ids.special) > 1:
        raise ValueError("one special string is supported")
    mark = b"".join(ids.special.values())
    for a, b in grouped(texts, 1_000_000):
        parts, owner, _ = split_special(texts[a:b], set(ids.special))
        found = pieces(parts)
        ids.learn(set().union(*found))
        made = [b"".join(map(ids.__getitem__, p)) for p in found]
        at = 0
        for k in range(b - a):
            to = at
            while to < len(owner) and owner[to] == k:
                to += 1
            yield mark.join(made[at:to])
            at = to


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of n tokens: whole ones at the end, a shorter one first."""
    head = n % most
    return ([(0, head)] if head else []) + [(k, most) for k in range(head, n, most)]

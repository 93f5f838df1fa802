"""The split of a byte-level tokenizer as a finite-state machine run on many chunks at once.

The public pattern (contractions, letters, numbers, other signs, each with an
optional blank before it, and white space) is compiled to a machine over ten
character classes. A transition says whether a piece starts at the character
read or at the one before it, so no look-ahead is needed.

Texts are cut into chunks of equal length that are stepped together. A chunk's
map from entry state to exit state comes from a few steps with all entry states:
they fall together almost at once, so the rest of the chunk is stepped once. A
parallel prefix scan composes the maps of a text's chunks, which gives each
chunk its entry state; only the chunks' first characters are then read again.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

# Character classes.
_L, _S, _R, _LL, _E, _N, _A, _O, _SP, _W, _PAD = range(11)
# States: what the piece being read is.
START, LETTERS, NUMBER, OTHER, BLANK, SPACE, BLANKS, SPACES, APOSTROPHE, APO_RV, APO_L, CONTRACTION = range(12)
STATES = 12
CHUNK = 256
HEAD = 8
_HERE, _BEFORE = 16, 32  # a piece starts at this character; at the one before

#: Code points of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0                　"


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    kinds = np.full(sys.maxunicode + 1, _O, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kinds[c] = _L
        elif major == "N":
            kinds[c] = _N
    kinds[[ord(c) for c in WHITE_SPACE]] = _W
    for chars, kind in (("stmd", _S), ("rv", _R), ("l", _LL), ("e", _E), ("'", _A), (" ", _SP)):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


def _step(state: int, kind: int) -> int:
    """Next state with the start marks."""
    letter = kind in (_L, _S, _R, _LL, _E)
    if kind == _PAD:
        return state
    if state == APO_RV and kind == _E or state == APO_L and kind == _LL:
        return CONTRACTION
    if state == APOSTROPHE:
        if kind == _S:
            return CONTRACTION
        if kind == _R:
            return APO_RV
        if kind == _LL:
            return APO_L
    late = _BEFORE if state in (APO_RV, APO_L) else 0  # no contraction: its letter starts a piece
    if late:
        state = LETTERS
    if kind in (_SP, _W):
        if state in (BLANK, SPACE, BLANKS, SPACES):
            return BLANKS if kind == _SP else SPACES
        return (BLANK if kind == _SP else SPACE) | _HERE | late
    if state in (BLANKS, SPACES):  # the run's last character leaves it
        late = _BEFORE
    joined = state in (BLANK, BLANKS)
    here = 0 if joined else _HERE
    if letter:
        return LETTERS | late | (0 if state == LETTERS else here)
    if kind == _N:
        return NUMBER | late | (0 if state == NUMBER else here)
    if state in (OTHER, APOSTROPHE):
        return OTHER
    if kind == _A and not joined:
        return APOSTROPHE | late | here
    return OTHER | late | here


@cache
def machine() -> np.ndarray:
    """Transitions, indexed by class * 16 + state."""
    table = np.zeros(16 * 11, dtype=np.uint8)
    for kind in range(11):
        for state in range(STATES):
            table[kind * 16 + state] = _step(state, kind)
    return table


def scan(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix composition of ``maps`` within runs that begin where ``first`` is set."""
    maps, closed = maps.copy(), first.copy()
    step = 1
    while step < len(maps) and not closed.all():
        todo = np.flatnonzero(~closed[step:]) + step
        before, done = maps[todo - step], closed[todo - step]
        maps[todo] = np.take_along_axis(maps[todo], before, axis=1)
        closed[todo] |= done
        step *= 2
    return maps


def starts(texts: list[str]) -> list[np.ndarray]:
    """For each text the positions at which its pieces start."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    chunks = -(-sizes // CHUNK)
    begin = np.concatenate(([0], np.cumsum(chunks)))
    total = int(begin[-1])
    if not total:
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    kinds, of = np.full(total * CHUNK, _PAD, dtype=np.uint8), classes()
    for t, b in zip(texts, begin):
        kinds[b * CHUNK : b * CHUNK + len(t)] = of[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    steps = np.ascontiguousarray(kinds.reshape(total, CHUNK).T).astype(np.int16) << 4
    table = machine()
    first = np.zeros(total, dtype=bool)
    first[begin[:-1][chunks > 0]] = True

    # Maps: a few characters from every state, the rest from the state they meet in.
    lanes = np.broadcast_to(np.arange(STATES, dtype=np.uint8)[:, None], (STATES, total))
    for k in range(HEAD):
        lanes = table[steps[k][None, :] + lanes] & 15
    lanes = np.where(first[None, :], lanes[START][None, :], lanes)
    open_ = np.flatnonzero((lanes != lanes[0]).any(axis=0))
    marks = np.zeros((CHUNK, total), dtype=np.uint8)
    state = lanes[0]
    for k in range(HEAD, CHUNK):
        got = table[steps[k] + state]
        state = got & 15
        marks[k] = got >> 4
    maps = np.repeat(state[:, None], STATES, axis=1)
    if len(open_):
        some = lanes[:, open_]
        for k in range(HEAD, CHUNK):
            some = table[steps[k][open_][None, :] + some] & 15
        maps[open_] = some.T
    maps = scan(maps, first)
    leave = maps[:, START]
    enter = np.concatenate(([START], leave[:-1]))
    enter[first] = START

    state = enter
    for k in range(HEAD):
        got = table[steps[k] + state]
        state = got & 15
        marks[k] = got >> 4
    if len(open_):
        state = state[open_]
        for k in range(HEAD, CHUNK):
            got = table[steps[k][open_] + state]
            state = got & 15
            marks[k, open_] = got >> 4
    flat = np.ascontiguousarray(marks.T).reshape(-1)
    at = flat & 1
    at[:-1] |= flat[1:] >> 1
    out = []
    for n, b, e in zip(sizes, begin[:-1], begin[1:]):
        if n and leave[e - 1] in (APO_RV, APO_L):
            at[b * CHUNK + n - 1] = 1
        out.append(np.flatnonzero(at[b * CHUNK : b * CHUNK + n]))
    return out


def pieces(texts: list[str]) -> list[list[str]]:
    """The pieces of each text."""
    out = []
    for t, s in zip(texts, starts(texts)):
        p = s.tolist()
        out.append([t[a:b] for a, b in zip(p, [*p[1:], len(t)])])
    return out


def grouped(texts: list[str], characters: int = 4_000_000):
    """Slices of the list with about so many characters each."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= characters:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)

"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact verification.

Items are put in classes of similar length. An item is probed by its first and
its last words, as many as the shortest item of its class has, so that every
window of that many words in a document can meet it at distance zero. Window
fingerprints come from running sums of the shingles' hash bits. A multi-index
over three blocks of bits, each entered with all its neighbours, returns every
probe within the radius. What it returns is verified on the item's full length
by the weighted Jaccard similarity of the shingles with their counts.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, ship
from shelfvoice.llm.presplit import grouped
from shelfvoice.llm.toxicity import Words

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of 64 within which every probe is returned: at most three of them in one of the blocks (lowest bit, size).
RADIUS = 11
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Items of a length class are at most so many times as long as its shortest.
CLASS_RATIO = 1.25
#: Shingles of a window, as sums are kept in a byte.
MOST_SHINGLES = 255
#: Items that are searched at once; more items are searched in blocks.
ITEMS_AT_ONCE = 1_000
_SPAN = 4096

SCHEMA = "doc_id long, item_id long, start_word long, n_words int, distance int, similarity double"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return _mix(h)


def bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def simhash(h: np.ndarray) -> int:
    ones = bits(h).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of shingles, their counts being the weights."""
    _, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(flat[: len(a)], minlength=flat.max() + 1), np.bincount(flat[len(a) :], minlength=flat.max() + 1)
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Probes:
    """Items of one length class and shingle size, indexed by blocks."""

    def __init__(self, shingle: int, width: int, items: list[tuple[int, np.ndarray]]):
        self.shingle, self.width = shingle, width
        self.count = width - shingle + 1
        self.items = items
        self.grams = [shingle_hashes(w, shingle) for _, w in items]
        found = []
        for k, (_, w) in enumerate(items):
            for shift in {0, len(w) - width}:
                found.append((simhash(self.grams[k][shift : shift + self.count]), k, shift))
        self.print = np.array([f[0] for f in found], dtype=np.uint64)
        self.item = np.array([f[1] for f in found], dtype=np.int64)
        self.shift = np.array([f[2] for f in found], dtype=np.int64)
        self.index = []
        for low, size in BLOCKS:
            near = [sum(1 << b for b in c) for n in range(RADIUS // len(BLOCKS) + 1) for c in itertools.combinations(range(size), n)]
            own = ((self.print >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64)
            values = (own[:, None] ^ np.array(near)).reshape(-1)
            order = np.argsort(values, kind="stable")
            there = np.zeros(1 << size, dtype=bool)
            there[values] = True
            self.index.append((np.packbits(there, bitorder="little"), values[order], order // len(near)))

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, probes and distances of all pairs within the radius."""
        at, who = [], []
        for (low, size), (there, values, ids) in zip(BLOCKS, self.index):
            own = ((prints >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64)
            hit = np.flatnonzero((there[own >> 3] >> (own & 7).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            lo, hi = np.searchsorted(values, own[hit]), np.searchsorted(values, own[hit], "right")
            n = hi - lo
            at.append(np.repeat(hit, n))
            who.append(ids[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        if not at:
            return (np.zeros(0, dtype=np.int64),) * 3
        at, who = np.concatenate(at), np.concatenate(who)
        d = np.bitwise_count(prints[at] ^ self.print[who])
        keep = d <= RADIUS
        if not keep.any():
            return (np.zeros(0, dtype=np.int64),) * 3
        pair = np.unique(np.stack((at[keep], who[keep], d[keep].astype(np.int64))), axis=1)
        return pair[0], pair[1], pair[2]


def classes(items: list[tuple[int, str | None]]) -> list[Probes]:
    """Length classes; items without words are left out."""
    sized: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, text in items:
        w = word_hashes(WORD.findall((text or "").lower()))
        if len(w):
            sized.setdefault(len(w), []).append((item, w))
    out: list[Probes] = []
    left = sorted(sized)
    while left:
        least = left[0]
        shingle = min(SHINGLE, least)
        # Items shorter than a shingle are one shingle, and a class to themselves.
        own = [n for n in left if n == least or least >= SHINGLE and (n <= CLASS_RATIO * least or least - shingle + 1 >= MOST_SHINGLES)]
        out.append(Probes(shingle, min(least, MOST_SHINGLES + shingle - 1), [x for n in own for x in sized[n]]))
        left = [n for n in left if n not in own]
    return out


def window_sums(rows: np.ndarray, counts: set[int]) -> dict[int, np.ndarray]:
    """Sums of each ``count`` rows in a row, put together from sums over powers of two."""
    doubled, k = {1: rows}, 1
    while 2 * k <= max(counts):
        doubled[2 * k] = doubled[k][:-k] + doubled[k][k:] if len(doubled[k]) > k else rows[:0]
        k *= 2
    out = {}
    for count in counts:
        n, total, at = len(rows) - count + 1, None, 0
        for power, sums in doubled.items():
            if count & power and n > 0:
                total = sums[at : at + n] if total is None else total + sums[at : at + n]
                at += power
        out[count] = rows[:0] if total is None else total
    return out


def search_words(words: np.ndarray, bounds: np.ndarray, probes: list[Probes]) -> list[tuple[int, int, int, int, int, float]]:
    """``(text, item, start word, words, distance, similarity)`` of each verified place, the best of those that overlap.

    ``words`` holds texts one after another, text k from ``bounds[k]`` on;
    windows over two texts are made, as that is simpler, and let go.
    """
    found: dict[tuple[int, int, int, int], tuple[int, float]] = {}
    for shingle in {p.shingle for p in probes}:
        grams = shingle_hashes(words, shingle)
        own = [p for p in probes if p.shingle == shingle and p.count <= len(grams)]
        reach = max((p.count for p in own), default=0)
        for base in range(0, len(grams) if own else 0, _SPAN):
            part = grams[base : base + _SPAN + reach - 1]
            sums = window_sums(bits(part), {p.count for p in own})
            for p in own:
                ones = sums[p.count][:_SPAN]
                prints = np.packbits((ones > p.count // 2).reshape(-1)).view(">u8").astype(np.uint64)
                for at, who, d in zip(*(x.tolist() for x in p.search(prints))):
                    k = int(p.item[who])
                    item, w = p.items[k]
                    start = base + at - int(p.shift[who])
                    text = int(np.searchsorted(bounds, start, "right")) - 1
                    if start < 0 or start + len(w) > bounds[text + 1] or (text, item, start, len(w)) in found:
                        continue
                    alike = similarity(p.grams[k], grams[start : start + len(w) - shingle + 1])
                    if alike >= SIMILARITY:
                        found[text, item, start, len(w)] = d, alike
    out: list[tuple[int, int, int, int, int, float]] = []
    for (text, item, start, n), (d, alike) in sorted(found.items()):
        made = (text, item, start - int(bounds[text]), n, d, alike)
        if out and out[-1][:2] == made[:2] and made[2] < out[-1][2] + out[-1][3]:
            if alike > out[-1][5]:
                out[-1] = made
            continue
        out.append(made)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, distance, similarity)``, a row for each place where a document holds an item.

    Words are runs of letters, digits and underscores, in lower case; a place
    counts when the weighted similarity of its five-word shingles with the
    item's is 0.8 or more and the fingerprint of its first or last words lies
    within the radius. Of overlapping places of one item the best stays. Null
    and empty texts and items hold nothing; items shorter than a shingle match
    as a whole; repeated documents give repeated rows, repeated items one; null
    ids pass through. Other columns are not read. One narrow pass over the
    documents for each ``ITEMS_AT_ONCE`` items, no shuffle of documents.
    """
    ship(docs.sparkSession)
    source = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, item_col, item_text):
        part = source.mapInArrow(_search(items), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(benchmark: DataFrame, item_col: str, item_text: str):
    """The stated query set in blocks of about ITEMS_AT_ONCE items, of which one reaches the driver at a time."""
    items = benchmark.select(col(item_col).cast("long").alias("item_id"), col(item_text).cast("string").alias("text")).distinct()
    blocks = max(1, -(-items.count() // ITEMS_AT_ONCE))
    for block in range(blocks):
        chosen = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield [(r[0], r[1]) for r in chosen]


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    def free_of(items):
        @F.pandas_udf("boolean")
        def free(texts: pd.Series) -> pd.Series:
            probes = classes(sorted(items, key=str))
            held = np.zeros(len(texts), dtype=bool)
            for k, *_ in _places(["" if t is None else t for t in texts], probes):
                held[k] = True
            return pd.Series(~held)

        return free

    ship(docs.sparkSession)
    for items in _blocks(benchmark, item_col, item_text):
        docs = docs.filter(free_of(items)(col(text_col).cast("string")))
    return docs


def _places(texts: list[str], probes: list[Probes]):
    """``(text, item, start word, words, distance, similarity)`` over a list of texts."""
    for a, b in grouped(texts, 2_000_000):
        number = Words()
        lists = [np.fromiter(map(number.__getitem__, WORD.findall(t.lower())), dtype=np.int64) for t in texts[a:b]]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        if bounds[-1]:
            for k, *found in search_words(word_hashes(number)[np.concatenate(lists)], bounds, probes):
                yield a + k, *found


def _search(items: list[tuple[int, str | None]]):
    def run(batches):
        probes = classes(sorted(items, key=str))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = [(ids[k], *x) for k, *x in _places(texts, probes)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    return run

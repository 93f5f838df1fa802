"""Alignment of the tokens of two tokenizers over the same text.

Texts are grouped by their whole content, so each distinct text is tokenised and
aligned once, in one place, with the number of its copies. Counts of linked id
pairs over the corpus weigh a text by its copies; a text's measures are then
joined to all documents that hold it, by a digest of the text.

Both tokenizers end a token before a blank that follows something other than
white space. The stretches between such places are aligned one by one, each
distinct stretch once in a task, and a text is put together from its stretches.
Of a stretch only the token ends matter: those of both tokenizers cut it into
intervals, and each interval is the overlap of one token of either.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, ship, stage
from shelfvoice.llm.token_counts import byte_alphabet
from shelfvoice.operators.joins import lookup_left

#: Stretches a worker remembers; beyond it forgets and goes on.
MAX_STRETCHES = 300_000
#: Characters of texts that are aligned together.
BATCH_CHARS = 2_000_000

#: A stretch goes on over blanks that follow white space (U+180E was once such).
_STRETCH = re.compile("(?s).(?:[^ ]+|(?<=[\\s᠎]) )*")
_ALIGNED = "text_key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Aligner(dict):
    """Stretch to its number, with the arrays that hold what is known of each number."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in alphabet for c in t)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.a_signs, self.b_signs = _Signs(self.a_bytes, ",", "|"), _Signs(self.b_bytes, ",", ";")
        self.lead = self.b.encode("a")
        self.whole = any(re.search("[^▁]▁", p) for p in pieces) or "".join(self.b.encode("a  b ", out_type=str)) != "▁a▁▁b▁"
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.names: list[str] = []
        #: A tokens, B tokens, groups, links, and whether the tokens give the stretch back.
        self.table = np.zeros((0, 5), np.int64)
        self.links = np.zeros(0, np.int64)  # A id * size of B + B id, stretch by stretch
        self.first = np.zeros(1, np.int64)

    def stretches(self, text: str) -> list[str]:
        """Of the text with a blank before it. Where the pieces may go over blanks the text is one stretch."""
        return [" " + text] if self.whole else _STRETCH.findall(" " + text)

    def learn(self, found: set[str]) -> None:
        new = [s for s in found if s not in self]
        if len(self) + len(new) > MAX_STRETCHES:
            self.forget()
            new = list(found)
        if not new:
            return
        a = [x.ids for x in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # The library puts a blank before a text. Behind "a" a stretch has its own, which is always where a token starts.
        lead = len(self.lead)
        b = [x[lead:] if x[:lead] == self.lead else [] for x in self.b.encode(["a" + s for s in new], num_threads=1)]
        of_a, of_b = (lambda i: self.a_bytes.get(i, b"")), self.b_bytes.__getitem__
        fine = [b"".join(map(of_a, x)) == (raw := s.encode()) and b"".join(map(of_b, y)) == raw for s, x, y in zip(new, a, b)]
        self.update(zip(new, itertools.count(len(self))))
        names, table, links = self._align([x if f else [] for x, f in zip(a, fine)], [y if f else [] for y, f in zip(b, fine)])
        self.names += names
        self.table = np.concatenate((self.table, np.column_stack((table, fine))))
        self.links = np.concatenate((self.links, links))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(table[:, 3])))

    def _align(self, a: list[list[int]], b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Names of the groups, counts and links of stretches whose tokens of either kind have the same bytes.

        Laid end to end they are one text, in which every stretch ends a group.
        """
        rows = len(a)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, rows) for x in (a, b))
        a_ids, b_ids = (np.fromiter(itertools.chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
        a_ends, b_ends = np.cumsum(self.a_signs.size[a_ids]), np.cumsum(self.b_signs.size[b_ids])
        owner = np.repeat(np.arange(rows), n_a)
        ends = np.union1d(a_ends, b_ends)
        at_a = np.searchsorted(a_ends, ends)
        links = a_ids[at_a] * len(self.b_bytes) + b_ids[np.searchsorted(b_ends, ends)]
        common = np.intersect1d(a_ends, b_ends)
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        signs = np.concatenate((self.a_signs.of(a_ids, common[a_group] == a_ends), self.b_signs.of(b_ids, common[b_group] == b_ends)))
        signs = signs[np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")].tolist()
        bounds = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        names = ["".join(signs[i:j])[:-1] for i, j in itertools.pairwise(bounds)]
        counted = [np.bincount(owner[x], minlength=rows) for x in (np.searchsorted(a_ends, common), at_a)]
        return names, np.column_stack((n_a, n_b, *counted)), links

    def texts(self, texts: list[str]):
        """``(n_a, n_b, n_groups, n_links)`` rows, group digests, and the pairs of all texts with their numbers and bounds."""
        found = [self.stretches(t) for t in texts]
        self.learn(set(itertools.chain.from_iterable(found)))
        sizes = np.array(list(map(len, found)))
        at = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(found)), np.int64, sizes.sum())
        starts = np.cumsum(sizes) - sizes
        rows = np.add.reduceat(self.table[at], starts, axis=0)
        fine = (rows[:, 4] == sizes) & np.array([t != "" for t in texts])
        rows = rows[:, :4] * fine[:, None]
        names = list(map(self.names.__getitem__, at.tolist()))
        digests = [hashlib.sha256(";".join(names[s : s + n]).encode()).hexdigest() if f else "" for s, n, f in zip(starts.tolist(), sizes.tolist(), fine.tolist())]
        owner = np.repeat(np.arange(len(texts)), sizes)
        keep = fine[owner]
        held, often = np.unique(owner[keep] * len(self) + at[keep], return_counts=True)
        owner, at = held // len(self), held % len(self)
        count = self.first[at + 1] - self.first[at]
        place = np.arange(count.sum()) + np.repeat(self.first[at] - np.cumsum(count) + count, count)
        size_b = len(self.b_bytes)
        kinds = self.a_signs.kinds * size_b
        keys = np.repeat(owner, count) * kinds + self.links[place]
        order = np.argsort(keys)
        keys, weights = keys[order], np.repeat(often, count)[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        keys = keys[new]
        times = np.add.reduceat(weights, new) if len(new) else new
        bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * kinds)
        pairs = keys % kinds
        return rows, digests, pairs // size_b << 32 | pairs % size_b, times, bounds


class _Signs:
    """Of the tokens of one vocabulary: sizes in bytes, and ids as text with the mark that follows in or after a group's list."""

    def __init__(self, of_id: dict[int, bytes], inside: str, last: str):
        self.kinds = max(of_id) + 1
        self.size = np.array([len(of_id.get(i, b"")) for i in range(self.kinds)])
        self.inside, self.last = (np.array([f"{i}{mark}" for i in range(self.kinds)], object) for mark in (inside, last))

    def of(self, ids: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return np.where(ending, self.last[ids], self.inside[ids])


@lru_cache(2)
def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    return Aligner(bytes_path, pieces_path)


def _groups(texts: list[str]):
    """Bounds of runs of texts with about ``BATCH_CHARS`` characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def aligned(texts: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Distinct texts ``(text, copies)`` with their digest, measures and linked pairs (A id << 32 | B id) with their numbers."""

    def run(batches):
        known = aligner(bytes_path, pieces_path)
        for batch in batches:
            all_texts = batch.column(0).to_pylist()
            for at, to in _groups(all_texts):
                part = all_texts[at:to]
                rows, digests, pairs, times, bounds = known.texts(part)
                keys = [hashlib.sha256(t.encode()).digest() for t in part]
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, t)) for v, t in ((pairs, pa.int64()), (times, pa.int32()))]
                columns = [pa.array(keys, pa.binary()), batch.column(1).slice(at, to - at), *(pa.array(rows[:, k], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["text_key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return texts.mapInArrow(run, _ALIGNED)


def pair_counts(texts: DataFrame) -> DataFrame:
    """``(pair, documents, best)`` of ``aligned`` texts: the documents that hold the pair linked, and whether no pair of its A id has more."""
    counts = stage(texts.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("documents")), "pair-counts")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("a_id")).agg(F.max("documents").alias("most"))
    return counts.withColumn("a_id", first).join(most, "a_id").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def align(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``.

    A is a byte-level vocabulary for the tokenizers library, read over a blank
    and the text; B is a sentencepiece model, which adds the blank itself.
    Special strings are plain text. Null and empty texts, and texts that the
    tokens of either don't give back byte by byte, have zeros and no digest.
    Repeated rows and null ids keep their rows, and each counts as a document.
    Texts are read whole. An empty table gives an empty one; other columns are
    not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = stage(aligned(rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies")), bytes_path, pieces_path), "aligned")
    pairs = stage(pair_counts(texts), "pairs")
    places = texts.select("text_key", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("text_key", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    counted = lookup_left(places, pairs, "pair", F.col("text_key"))
    sums = counted.groupBy("text_key").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    measures = texts.drop("copies", "pairs", "times").join(sums, "text_key", "left")
    measures = stage(measures.select("text_key", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), "measures")
    keyed = stage(rows.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key")), "keyed")
    return lookup_left(keyed, measures, "text_key", F.col("doc_id")).drop("text_key").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

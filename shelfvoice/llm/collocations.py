"""Phrases whose words belong together, by best-first growth with score bounds.

Words and word pairs are counted first; a pair's parts give its exact score. A
pair then stands at the root of all triples that it begins, and its count over
that of its first word bounds all their scores: for a triple counted ``a`` with
the first word counted ``l``, the cut after that word scores at most ``a / l``,
and no triple occurs more often than the pair it grows from.

The frontier is expanded from the best bound down. One expansion grows every
pair whose bound reaches a level, and counts whatever contains a pair that
scores so much, since a longer phrase may drop it. Then every phrase from that
level up is known, with its fate. Where fewer than ``top`` phrases survive the
level falls, in the end to zero; where enough do, the language is settled, its
last place and the ties of that place included.

Texts are read as bytes and words numbered by each task, which counts phrases as
sorted numbers, boundedly many, and Spark adds up what the tasks send. What an
expansion grows goes to the tasks as two bitmaps of fixed size: a chance hit
counts a phrase too many, never one too few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, ship, stage

#: Places and phrases a task gathers before it sums them, and words it numbers; it sends all on if half as many phrases are left.
MAX_ENTRIES, MAX_WORDS = 3_000_000, 400_000
#: Bits of a word's number, and pairs of a language whose fate is remembered, as a power of two.
WORD_BITS, REMEMBERED_BITS = 21, 19
#: Bytes of text that a task copies at a time.
MAX_BYTES = 4 << 20
#: Bytes of text that are cut into words at a time.
CHUNK = 1 << 20
#: Bits of an expansion's bitmaps, as a power of two; 4 MB each.
FRONTIER_BITS = 25
#: Parts in which a language's phrases are ranked before the last ranking.
RANK_PARTS = 64
#: Times as many phrases as asked for that the first expansion settles, and the factor of each further one.
FIRST_SHARE, WIDEN = 2, 8
UNIT = 1_000_000
NO_LANGUAGE = "und"

_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + b".,;:!?\n\x0b\x0c\r" + b"\t",
    bytes(range(ord("a"), ord("z") + 1)) + _BREAK * 10 + b" ",
)


def _chunks(texts: list[bytes | None]):
    """Lists of ``MAX_WORDS`` words at most, ``_BREAK`` wherever a phrase may not go on; a word is never cut."""
    data = _BREAK.join(t for t in texts if t).translate(_TABLE)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + CHUNK)
        to = len(data) if to < 0 else to
        words = data[at:to].replace(_BREAK, b" \xff ").split()
        for k in range(0, len(words), MAX_WORDS):
            yield words[k : k + MAX_WORDS]
        at = to


def _by_language(batch):
    """``(lang, texts)`` of a batch with the columns lang and text, a few megabytes at a time."""
    langs = batch.column(0).to_pylist()
    texts = batch.column(1).cast(pa.binary())
    by: dict[str, list] = {}
    size = 0
    for k, lang in enumerate(langs):
        text = texts[k].as_py()
        by.setdefault(NO_LANGUAGE if lang is None else lang, []).append(text)
        size += len(text or b"")
        if size > MAX_BYTES:
            yield from by.items()
            by, size = {}, 0
    yield from by.items()


class _Words(dict):
    """Words to their numbers; ``_BREAK`` is 0."""

    def __init__(self):
        self.names = [_BREAK]
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self.names)
        self.names.append(word)
        return made

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class _Counts:
    """Counts of one language's phrases; a phrase is the numbers of its words in one integer."""

    def __init__(self):
        self.phrases, self.counts, self.new = np.empty(0, np.int64), np.empty(0, np.int64), []

    def summed(self) -> int:
        """Sum what was added since; the phrases there are now."""
        if self.new:
            phrases, counts = np.unique(np.concatenate(self.new), return_counts=True)
            phrases, counts = np.concatenate((self.phrases, phrases)), np.concatenate((self.counts, counts))
            order = np.argsort(phrases, kind="stable")
            phrases, counts = phrases[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], phrases[1:] != phrases[:-1])))
            self.phrases, self.counts, self.new = phrases[first], np.add.reduceat(counts, first), []
        return len(self.phrases)


class _Task:
    """What a task has counted: numbered words, and counts by language."""

    def __init__(self, n: int):
        self.n, self.words, self.by, self.entries = n, _Words(), {}, 0

    def add(self, lang: str, phrases: np.ndarray) -> None:
        if len(phrases):
            self.by.setdefault(lang, _Counts()).new.append(phrases)
            self.entries += len(phrases)

    def full(self) -> bool:
        """Whether the counts must be sent on, and the words forgotten, before more is added."""
        if self.entries > MAX_ENTRIES:
            self.entries = sum(c.summed() for c in self.by.values())
        return self.entries > MAX_ENTRIES // 2 or len(self.words) > MAX_WORDS

    def rows(self):
        """The counted phrases as rows; for pairs also their second words, each of which stands in one pair a place, and as no words at all how many there are."""
        names = pa.array(self.words.names, pa.binary())
        for lang, counts in self.by.items():
            counts.summed()
            parts = [counts.phrases >> WORD_BITS * k & (1 << WORD_BITS) - 1 for k in reversed(range(self.n))]
            if self.n == 2:
                ones = np.zeros(len(self.words), np.int64)
                np.add.at(ones, parts[1], counts.counts)
                ones[0] = 0
                used = np.flatnonzero(ones)
                yield from _rows(lang, 0, names, [], np.array([ones.sum()]))
                yield from _rows(lang, 1, names, [used], ones[used])
            whole = np.logical_and.reduce(parts)
            yield from _rows(lang, self.n, names, [p[whole] for p in parts], counts.counts[whole])
        self.words, self.by, self.entries = _Words(), {}, 0


def _rows(lang: str, words: int, names: pa.Array, parts: list[np.ndarray], counts: np.ndarray):
    for at in range(0, len(counts), 100_000):
        n = min(100_000, len(counts) - at)
        named = [names.take(pa.array(p[at : at + n])) for p in parts]
        phrases = pc.binary_join_element_wise(*named, b" ") if named else pa.array([b""] * n, pa.binary())
        columns = [pa.array([lang] * n, pa.string()), pa.array(np.full(n, words, np.int32)), phrases.cast(pa.string()), pa.array(counts[at : at + n])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "f"])


def _count_short(batches):
    """Task: counts of words and pairs, and as no words at all the number of words."""
    task = _Task(2)
    for batch in batches:
        for lang, texts in _by_language(batch):
            last = _BREAK
            for words in _chunks(texts):
                if task.full():
                    yield from task.rows()
                numbers = task.words.numbers([last, *words])
                task.add(lang, numbers[:-1] << WORD_BITS | numbers[1:])
                last = words[-1]
    yield from task.rows()


class _Grown:
    """Pairs of numbers to 1 if triples that they begin are wanted, 2 if those that they end are, 3 for both."""

    def __init__(self, lang: str, begins: np.ndarray, ends: np.ndarray):
        self.lang, self.begins, self.ends = lang.encode(), begins, ends
        self.forget()

    def forget(self) -> None:
        """Before words are numbered anew. A place remembers the last of its pairs, at first that of two breaks."""
        self.pairs, self.kinds = np.zeros(1 << REMEMBERED_BITS, np.int64), np.zeros(1 << REMEMBERED_BITS, np.uint8)

    def of(self, pairs: np.ndarray, names: list[bytes]) -> np.ndarray:
        import xxhash

        places = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - REMEMBERED_BITS)).astype(np.int64)
        kinds = np.where(self.pairs[places] == pairs, self.kinds[places], 255)
        missing = np.flatnonzero(kinds == 255)
        if len(missing):
            new, where = np.unique(pairs[missing], return_inverse=True)
            first, second = new >> WORD_BITS, new & (1 << WORD_BITS) - 1
            start, low = self.lang + b" ", (1 << FRONTIER_BITS) - 1
            digest = xxhash.xxh64_intdigest
            bits = np.fromiter((digest(start + names[a] + b" " + names[b], 42) & low for a, b in zip(first.tolist(), second.tolist())), np.int64, len(new))
            found = (self.begins[bits >> 3] >> (bits & 7) & 1 | (self.ends[bits >> 3] >> (bits & 7) & 1) << 1).astype(np.uint8)
            found[(first == 0) | (second == 0)] = 0
            kinds[missing] = made = found[where]
            # Pair and kind of a place must be of one place: the last one written wins in both.
            self.pairs[places[missing]] = pairs[missing]
            self.kinds[places[missing]] = made
        return kinds


def _count_grown(begins, ends):
    """Task: counts of the triples that an expansion wants."""

    def run(batches):
        first, second = (np.frombuffer(b.value, np.uint8) for b in (begins, ends))
        task, wanted = _Task(3), {}
        for batch in batches:
            for lang, texts in _by_language(batch):
                if len(wanted) > 8 and lang not in wanted:
                    wanted.clear()
                grown = wanted.get(lang) or wanted.setdefault(lang, _Grown(lang, first, second))
                tail = [_BREAK, _BREAK]
                for words in _chunks(texts):
                    if task.full():
                        yield from task.rows()
                        for known in wanted.values():
                            known.forget()
                    words = tail + words
                    numbers = task.words.numbers(words)
                    pairs = numbers[:-1] << WORD_BITS | numbers[1:]
                    kinds = grown.of(pairs, task.words.names)
                    keep = np.flatnonzero((kinds[:-1] & 1 | kinds[1:] & 2) > 0)
                    task.add(lang, pairs[keep] << WORD_BITS | numbers[keep + 2])
                    tail = words[-2:]
        yield from task.rows()

    return run


def _added(texts: DataFrame, task) -> DataFrame:
    parts = texts.mapInArrow(task, "lang string, words int, phrase string, f long")
    return parts.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _wide(x: Column | str) -> Column:
    """Counts as decimals whose products are exact up to 38 digits."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(15,0)")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact."""
    made = (F.lit(UNIT).cast("decimal(7,0)") * (_wide(a) * _wide(a)).cast("decimal(30,0)")).cast("decimal(38,0)")
    return F.call_function("div", made, (_wide(left) * _wide(right)).cast("decimal(30,0)"))


def _bound(a: str, first: str) -> Column:
    """No phrase that goes on from one counted ``a``, whose first word is counted ``first``, scores more."""
    return F.call_function("div", (F.lit(UNIT).cast("decimal(7,0)") * _wide(a)).cast("decimal(30,0)"), _wide(first))


def _words(phrase: str, n: int) -> list[Column]:
    parts = F.split(phrase, " ", -1)
    return [parts[k].alias(f"w{k + 1}") for k in range(n)]


def _levels(scores: DataFrame, wanted: int) -> DataFrame:
    """``(lang, level)``: the greatest score that ``wanted`` rows of a language reach; 0 where there are fewer.

    Rows are counted by score first, of which there are a million and one at most.
    """
    by_score = scores.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("rows"))
    reached = by_score.withColumn("reached", F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)))
    level = F.max(F.when(F.col("reached") >= wanted, F.col("score")))
    return reached.groupBy("lang").agg(F.coalesce(level, F.lit(0).cast("long")).alias("level"))


def _bitmap(pairs: DataFrame) -> bytes:
    """The set of pairs as bits; at most 2^FRONTIER_BITS / 32768 rows of 4 KB reach the driver."""
    bits = F.xxhash64(F.concat_ws(" ", "lang", "w1", "w2")).bitwiseAND(F.lit((1 << FRONTIER_BITS) - 1).cast("long"))
    blocks = pairs.select(F.shiftright(bits, 15).alias("block"), bits.bitwiseAND(F.lit(32767).cast("long")).alias("bit"))
    made = bytearray(1 << (FRONTIER_BITS - 3))
    for row in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        made[row.block * 4096 : row.block * 4096 + len(row.bits)] = row.bits
    return bytes(made)


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, ranked in parts before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = rows.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    some = some.filter(F.col("place") <= top).drop("part", "place")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def _expanded(texts: DataFrame, pairs: DataFrame, levels: DataFrame, least: int, cover: int) -> DataFrame:
    """All phrases that reach their language's level and are in no longer phrase: ``lang, phrase, a, l, r, score``."""
    open_pairs = pairs.join(levels, "lang")
    spark = texts.sparkSession
    begins = spark.sparkContext.broadcast(_bitmap(open_pairs.filter("bound >= level")))
    ends = spark.sparkContext.broadcast(_bitmap(open_pairs.filter("score >= level")))
    triples = _added(texts, _count_grown(begins, ends)).filter(F.col("f") >= least)
    triples = stage(triples.select("lang", "phrase", *_words("phrase", 3), F.col("f").alias("a")), "triples")
    for sent in (begins, ends):
        sent.unpersist()
    first = pairs.select("lang", "w1", "w2", F.col("a").alias("a12"), F.col("f1").alias("a1"))
    second = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("f2").alias("a3"))
    parts = triples.join(first, ["lang", "w1", "w2"]).join(second, ["lang", "w2", "w3"])
    early, late = F.struct(score("a", "a1", "a23").alias("score"), F.lit(1).alias("cut")), F.struct(score("a", "a12", "a3").alias("score"), F.lit(2).alias("cut"))
    scored = parts.withColumn("best", F.least(early, late)).withColumn("after_one", F.col("best.cut") == 1)
    scored = scored.select("lang", "phrase", "a", F.when(F.col("after_one"), F.col("a1")).otherwise(F.col("a12")).alias("l"), F.when(F.col("after_one"), F.col("a23")).otherwise(F.col("a3")).alias("r"), F.col("best.score").alias("score"))
    inside = triples.select("lang", "a", F.explode(F.array(F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", "w2", "w3"))).alias("phrase"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    short = open_pairs.filter("score >= level").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    alone = short.join(longest, ["lang", "phrase"], "left").filter((100 * F.coalesce("longer", F.lit(0)) < cover * F.col("a"))).drop("longer")
    reached = scored.join(levels.select("lang", "level"), "lang").filter("score >= level").drop("level")
    return alone.unionByName(reached)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 2000, least: int = 10, cover: int = 50) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best phrases of two or three words.

    A phrase counts where its words follow each other between marks and line
    ends; ``a``, ``l`` and ``r`` are the counts of it and of its two parts at
    the worst cut, ``n`` all words of the language. A phrase needs ``least``
    places, and goes if a longer phrase with as many holds it and has at least
    ``cover`` percent of them.

    Null texts are empty, a null language is ``und`` (and meets texts of that
    name). Texts are read whole, in chunks. Repeated rows count each time. Equal
    scores are ordered by ``a``, then by the phrase's bytes. No words, no rows:
    an empty result. Other columns are not read.
    """
    texts = docs.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"))
    ship(texts.sparkSession)
    counts = stage(_added(texts, _count_short).filter((F.col("f") >= least) | (F.col("words") == 0)), "phrase-counts")
    word = counts.filter("words = 1")
    # Growth from a word needs no bound: its first pair may score everything.
    pairs = counts.filter("words = 2").select("lang", *_words("phrase", 2), F.col("f").alias("a"))
    pairs = pairs.join(word.select("lang", F.col("phrase").alias("w1"), F.col("f").alias("f1")), ["lang", "w1"])
    pairs = pairs.join(word.select("lang", F.col("phrase").alias("w2"), F.col("f").alias("f2")), ["lang", "w2"])
    pairs = stage(pairs.withColumns({"score": score("a", "f1", "f2"), "bound": _bound("a", "f1")}), "pairs")
    found, wanted, unsettled = None, FIRST_SHARE * top, pairs
    while True:
        levels = stage(_levels(unsettled, wanted), "levels")
        grown = stage(_expanded(texts, pairs, levels, least, cover), "phrases")
        settled = grown.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
        state = stage(levels.join(settled, "lang", "left").select("lang", ((F.coalesce("rows", F.lit(0)) >= top) | (F.col("level") == 0)).alias("done")), "settled")
        best = _ranked(grown.join(state.filter("done").select("lang"), "lang", "left_semi"), top)
        found = best if found is None else found.unionByName(best)
        if state.filter("NOT done").isEmpty():
            break
        unsettled = pairs.join(state.filter("NOT done").select("lang"), "lang", "left_semi")
        wanted *= WIDEN
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return found.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

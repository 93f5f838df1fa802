"""Near-duplicate groups by SimHash and a binary trie self-join.

Fingerprints are spread over tasks by their blocks: 64 bits are cut into
``radius + exact`` blocks, and two fingerprints within the radius agree in at
least ``exact`` of them, so for one choice of blocks they share all its bits.
The rows of one choice and value form the top of a trie in which no bit may
differ; below, node pairs are walked together, differing bits are added up, and
a pair of nodes is left as soon as the sum exceeds the radius. Of the pairs
found only a spanning forest leaves the task, never all pairs of a group.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, ship, stage
from shelfvoice.llm.components import components
from shelfvoice.operators.joins import fits_broadcast

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})
#: Distinct fingerprints of one trie that a task takes whole; larger ones are cut into subtrees.
TRIE_ROWS = 200_000
_FRONTIER = 500_000
_PAIRS = 2_000_000
_LEAF = 32

def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; no words: 0."""
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 16384):
        part = words[at : min(at + 16384, n) + shingle - 1]
        joined = map(" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else (" ".join(part),)
        h = np.fromiter((digest(s, 42) for s in joined), dtype=np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            found = [text_fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    ship(docs.sparkSession)
    source = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def trie_pairs(fps: np.ndarray, groups: np.ndarray, radius: int):
    """Index pairs of one trie within the radius, in blocks; ``fps`` (unsigned) ascend within each group.

    ``groups`` holds the bounds of the groups. A node is a range of the sorted
    array; the zeros of a bit, summed up once a level, give where it splits.
    """
    lo, hi = groups[:-1], groups[1:]
    keep = hi - lo > 1
    lo, hi = lo[keep].astype(np.int64), hi[keep].astype(np.int64)
    todo = [(63, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
    zeros: dict[int, np.ndarray] = {}
    while todo:
        bit, a, b, c, d, err = todo.pop()
        if len(a) > _FRONTIER:
            half = len(a) // 2
            todo += [(bit, a[s], b[s], c[s], d[s], err[s]) for s in (slice(0, half), slice(half, None))]
            continue
        small = ((b - a) * (d - c) <= _LEAF) | (bit < 0)
        if small.any():
            yield from _compare(fps, a[small], b[small], c[small], d[small], radius)
            a, b, c, d, err = (x[~small] for x in (a, b, c, d, err))
        if not len(a):
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0)))
        z = zeros[bit]
        m, n = a + z[b] - z[a], c + z[d] - z[c]
        same = a == c
        other = ~same
        parts = (
            (a, m, c, n, err),
            (m, b, n, d, err),
            (a, m, n, d, err + 1),
            tuple(x[other] for x in (m, b, c, n, err + 1)),
        )
        a, b, c, d, err = (np.concatenate(x) for x in zip(*parts))
        keep = (b > a) & (d > c) & (err <= radius) & ~((a == c) & (b - a < 2))
        todo.append((bit - 1, a[keep], b[keep], c[keep], d[keep], err[keep]))


def _compare(fps, a, b, c, d, radius):
    """All pairs of small node pairs, tested on whole fingerprints."""
    wide = (b - a) * (d - c) > _PAIRS
    if wide.any():  # many equal fingerprints: strips of the first node
        step = np.where(wide, np.maximum(1, _PAIRS // (d - c)), b - a)
        n = -(-(b - a) // step)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b, c, d, step = (np.repeat(x, n) for x in (a, b, c, d, step))
        a = a + k * step
        b = np.minimum(b, a + step)
    at = 0
    sizes = (b - a) * (d - c)
    ends = np.cumsum(sizes)
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        s = sizes[at:to]
        which = np.repeat(np.arange(at, to), s)
        k = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
        w = d[which] - c[which]
        i, j = a[which] + k // w, c[which] + k % w
        keep = i < j  # of two nodes the first lies before the second
        i, j = i[keep], j[keep]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        if near.any():
            yield i[near], j[near]
        at = to


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex that isn't the least of its component, with that least vertex."""
    names, flat = np.unique(np.concatenate((i, j)), return_inverse=True)
    u, v = flat[: len(i)], flat[len(i) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        for end in (u, v):
            np.minimum.at(after, end, low)
            np.minimum.at(after, label[end], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _joined(radius: int):
    """Task: rows sorted by trie and fingerprint in, forest edges out."""

    def links(trie: np.ndarray, fps: np.ndarray, guest: np.ndarray):
        bounds = np.flatnonzero(np.concatenate(([True], trie[1:] != trie[:-1], [True])))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in trie_pairs(fps, bounds, radius):
            home = ~(guest[i] & guest[j])
            held.append((i[home], j[home]))
            if sum(len(x[0]) for x in held) > _PAIRS:
                held = [forest(*(np.concatenate(x) for x in zip(*held)))]
        if held:
            i, j = forest(*(np.concatenate(x) for x in zip(*held)))
            u, v = fps[i].view(np.int64), fps[j].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return _by_trie(links, 3)


def _by_trie(work, columns: int):
    """Task: whole tries of sorted rows, so many at once that they fill ``TRIE_ROWS``, through ``work``."""

    def run(batches):
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)))
            size += batch.num_rows
            if size < TRIE_ROWS or kept[-1][0][-1] == kept[0][0][0]:
                continue
            rows = [np.concatenate(x) for x in zip(*kept)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last trie may go on in the next batch
            yield from work(rows[0][:cut], rows[1][:cut].view(np.uint64), *(x[:cut] for x in rows[2:]))
            kept, size = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
        if size:
            rows = [np.concatenate(x) for x in zip(*kept)]
            yield from work(rows[0], rows[1].view(np.uint64), *rows[2:])

    return run


def _masks(radius: int, exact: int) -> list[int]:
    blocks = radius + exact
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    bits = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(bounds)]
    return [sum(chosen) for chosen in itertools.combinations(bits, exact)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(choice, value, *more):
    """The sort key of a trie; two tries that meet in it would only be walked as one."""
    return F.xxhash64(choice, value, *more)


def links(prints: DataFrame, radius: int = 2, exact: int = 1, trie_rows: int = TRIE_ROWS, cut_bits: int = 10) -> DataFrame:
    """Edges ``(u, v)`` that connect every two distinct fingerprints ``fp`` within the radius.

    A trie with more than ``trie_rows`` rows is cut at ``cut_bits`` further bits:
    each row lives in its own subtree and visits those within the radius, so the
    pairs of a hot block are shared by many tasks.
    """
    masks = _masks(radius, exact)
    values = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks))
    tries = prints.select("fp", F.posexplode(values).alias("choice", "value")).select("fp", F.col("choice").cast("byte").alias("choice"), _hash("choice", "value").alias("trie"))
    # Large tries are named first, on their keys alone: a table of at most (rows / trie_rows) keys.
    large = stage(tries.groupBy("trie").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > trie_rows).select("trie"), "large-tries")
    if large.isEmpty():
        return _walked(tries.select("trie", "fp", F.lit(False).alias("guest")), radius)
    light = tries.join(F.broadcast(large), "trie", "left_anti").select("trie", "fp", F.lit(False).alias("guest"))
    # Bits outside the choice's blocks, highest first: the next levels of that trie.
    below = [[b for b in range(63, -1, -1) if not m >> b & 1][:cut_bits] for m in masks]
    child = F.lit(0)
    for k in range(cut_bits):
        shift = F.element_at(F.array(*(F.lit(b[k] if k < len(b) else 0) for b in below)), F.col("choice") + 1)
        child = child * 2 + F.call_function("shiftrightunsigned", F.col("fp"), shift).bitwiseAND(F.lit(1).cast("long"))
    flips = [sum(1 << b for b in chosen) for k in range(1, radius + 1) for chosen in itertools.combinations(range(cut_bits), k)]
    cut = tries.join(F.broadcast(large), "trie", "left_semi").withColumn("own", child.cast("int"))
    homes = cut.select(F.col("trie").alias("top"), "own", "fp", F.lit(False).alias("guest"))
    visits = (
        cut.select(F.col("trie").alias("top"), F.col("own").alias("from"), "fp", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
        .withColumn("own", F.col("from").bitwiseXOR(F.col("flip")))
        .filter(F.col("own") > F.col("from"))
        .select("top", "own", "fp", F.lit(True).alias("guest"))
    )
    heavy = homes.unionByName(visits).select(F.xxhash64("top", "own").alias("trie"), "fp", "guest")
    return _walked(light.unionByName(heavy), radius)


def _walked(rows: DataFrame, radius: int) -> DataFrame:
    """Deal rows ``trie, fp, guest`` by trie, sort them by bits and walk each trie."""
    # As signed longs the negative half would sort first; with the top bit flipped the bits decide.
    ordered = rows.withColumn("fp", _flip("fp")).repartition("trie").sortWithinPartitions("trie", "fp")
    return ordered.select("trie", _flip("fp").alias("fp"), "guest").mapInArrow(_joined(radius), "u long, v long")


def _flip(name: str):
    return F.col(name).bitwiseXOR(F.lit(_signed(1 << 63)).cast("long"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, exact: int = 1, trie_rows: int = TRIE_ROWS
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Two rows link when their fingerprints differ in at most ``radius`` bits;
    component_id is the least doc_id reachable. Null and empty texts have
    fingerprint zero and link like any other. A row whose id is null keeps its
    row and takes part, but its id never names a component (a component of null
    ids only has none). Repeated rows give repeated result rows; an empty table
    gives an empty one. Other columns of ``docs`` are not read.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = stage(components(links(distinct, radius, exact, trie_rows)), "components")
    named = distinct.join(found, F.col("fp") == F.col("vertex"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = stage(named.join(least, "root").select("fp", "component_id"), "groups")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, exact: int = 1) -> DataFrame:
    """The rows of ``docs``, one of each group of ``near_groups``, with all their columns: that of the least id, null ids last.

    Rows are numbered and staged first, so that repeated and null ids are rows
    of their own; of several rows with the least id one stays. Null and empty
    texts are one group, fingerprint zero. Texts are read whole, however long.
    Columns whose names also occur in here are kept as they are. An empty table
    gives an empty one.
    """
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = stage(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    groups = near_groups(rows, number, text_col, shingle, radius, exact).select(F.col("doc_id").alias(number), "component_id")
    named = rows.select(number, col(id_col).alias("id")).join(groups, number)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", number)).alias("first"))
    kept = first.select(F.col(f"first.{number}").alias(number))
    # The rows that go are the fewer; the documents only shuffle where even their numbers are too many to broadcast.
    gone = stage(groups.select(number).join(kept, number, "left_anti"), "gone")
    return rows.join(F.broadcast(gone) if fits_broadcast(gone) else gone, number, "left_anti").drop(number)

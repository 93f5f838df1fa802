"""Best-fit packing planned on the histogram of lengths.

Sequences have room for at most ``capacity`` tokens, so there are at most that
many different lengths, and packing can be planned on their counts alone: the
driver sees one number per length, whatever the input's size. The plan says
which ranks of a length go to which run of sequences at which offset. Documents
are ranked within their length and take their slots by a join on length and a
block of ranks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, partitions, ship, stage
from shelfvoice.llm.token_ids import cut, encode

CAPACITY = 2048
#: Blocks of ranks of one length in the join with the plan.
BLOCKS = 16


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit in falling order of length, on counts.

    Returns slots ``(length, rank, n, sequence, offset)``, meaning that ranks
    ``rank .. rank + n - 1`` of a length go to sequences ``sequence ..`` at the
    offset, and the number of sequences. Open sequences are kept as runs by the
    room they have left; what is used is the offset of the next slot. The number
    of slots depends on the lengths, not on the number of documents.
    """
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    slots: list[tuple[int, int, int, int, int]] = []
    made = 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        left, rank = counts[length], 0

        def fill(sequence: int, n: int, each: int, room: int):
            nonlocal left, rank
            for k in range(each):
                slots.append((length, rank, n, sequence, capacity - room + k * length))
                rank += n
            left -= n * each
            if room - each * length:
                runs[room - each * length].append((sequence, n))

        while left:
            room = next((r for r in range(length, capacity + 1) if runs[r]), None)
            each = (room or capacity) // length
            if room is None:
                sequence, n = made, -(-left // each)
                made += n
            else:
                sequence, n = runs[room].pop()
            full = min(n, left // each)
            if full:
                fill(sequence, full, each, room or capacity)
            if full < n:
                part = left
                if part:
                    fill(sequence + full, 1, part, room or capacity)
                    full += 1
                if full < n:
                    runs[room or capacity].append((sequence + full, n - full))
    return slots, made


def tokenized_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``; a document's ids end with ``end_id``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out: list[tuple] = []
            for doc, raw in zip(ids, encode(texts, path)):
                raw += end
                out += [(doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(raw) // 4, capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    source = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(pieces: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """Add ``rank``, from 0 within each length, without holding a length in one task.

    A length with more rows than its share is dealt over salts; ranks of a salt
    follow those of the salts before it. At most ``capacity`` lengths and four
    times as many salts as partitions exist, so the table of bases is small.
    """
    total, parts = sum(counts.values()), 4 * partitions(pieces.sparkSession)
    salts = [max(1, -(-counts.get(n, 0) * parts // max(1, total))) for n in range(1, capacity + 1)]
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(F.array(*map(F.lit, salts)), F.col("length").cast("int")))
    dealt = pieces.withColumn("salt", spread)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    bases = bases.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(bases), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place")).drop("salt", "place", "base")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a staged table with ``doc_id, piece, start, length, ids_crc32``."""
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # one row per length, at most ``capacity``
    slots, _ = plan(counts, capacity)
    width = {n: max(1, -(-c // BLOCKS)) for n, c in counts.items()}
    names = "length long, first long, n long, sequence long, offset long, block long"
    rows = [(*s, b) for s in slots for b in range(s[1] // width[s[0]], (s[1] + s[2] - 1) // width[s[0]] + 1)]
    planned = F.broadcast(spark.createDataFrame(rows, names))
    widths = F.element_at(F.array(*(F.lit(width.get(n, 1)).cast("long") for n in range(1, capacity + 1))), F.col("length").cast("int"))
    placed = ranked(pieces, counts, capacity).withColumn("block", F.floor(F.col("rank") / widths)).join(planned, ["length", "block"])
    placed = placed.filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    A document is its text's token ids and then id 0, so a null or empty text
    takes one token. Documents longer than the capacity are cut into full pieces
    after a shorter first one; no token is lost. Null and repeated ids pass
    through, each row being a document of its own; other columns are not read;
    an empty table gives an empty one.
    """
    return place(stage(tokenized_pieces(docs, path, id_col, text_col, capacity), "pieces"), capacity)

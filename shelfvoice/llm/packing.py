"""Packed token matrices: best fit in falling order inside each task, with a segment tree over free room."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shelfvoice.llm.common import col, ship
from shelfvoice.llm.token_ids import cut, encode

CAPACITY = 2048
#: Tokens that a task holds before it packs and writes them.
GROUP_TOKENS = 8_000_000

SCHEMA = "sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, pieces array<int>, starts array<long>"


class RoomTree:
    """Segment tree over room left, 0 to capacity: how many sequences have that room, summed upward."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.sums[at] += n
            at >>= 1

    def least(self, room: int) -> int:
        """The least room that is at least this and that some sequence has; -1 if none."""
        at = room + self.size
        if self.sums[at]:
            return room
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Members of each sequence, in the order of their places."""
    tree, by_room = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    out: list[list[int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        room = tree.least(n)
        if room < 0:
            room, which = capacity, len(out)
            out.append([])
        else:
            which = by_room[room].pop()
            tree.add(room, -1)
        out[which].append(item)
        if room > n:
            by_room[room - n].append(which)
            tree.add(room - n, 1)
    return out


def packed_matrices(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """One row per packed sequence of exactly ``capacity`` ids.

    ``ids`` are little-endian unsigned 32-bit, filled up with ``pad_id`` after
    ``n_tokens``; ``cu_seqlens`` runs from 0 to ``n_tokens``; ``position_ids``
    (unsigned 16-bit) start again at 0 with every segment; ``doc_ids``,
    ``pieces`` and ``starts`` name each segment. Documents (null text: empty) end
    with ``end_id``; longer ones are cut losslessly. Packing happens where the
    rows are: no shuffle, and a task holds at most about ``GROUP_TOKENS`` tokens.
    Ids pass through as they are; an empty table gives an empty one.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(base: int, pieces: list[tuple]) -> pa.RecordBatch:
        rows = best_fit(np.array([len(p[3]) // 4 for p in pieces]), capacity)
        cols: list[list] = [[] for _ in range(8)]
        for k, members in enumerate(rows):
            own = [pieces[m] for m in members]
            sizes = [len(p[3]) // 4 for p in own]
            ids = b"".join(p[3] for p in own)
            spots = np.concatenate([np.arange(s, dtype="<u2") for s in sizes])
            n = len(spots)
            fill = np.full(capacity - n, pad_id, dtype="<u4").tobytes()
            made = (base + k, ids + fill, n, [0, *np.cumsum(sizes).tolist()], spots.tobytes() + bytes(2 * (capacity - n)), *([p[c] for p in own] for c in range(3)))
            for c, v in zip(cols, made):
                c.append(v)
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    def run(batches):
        base, pieces, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, raw in zip(batch.column(0).to_pylist(), encode(texts, path)):
                raw += end
                pieces += [(doc, k, s, raw[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut(len(raw) // 4, capacity))]
                held += len(raw) // 4
                if held >= GROUP_TOKENS:
                    made = write(base, pieces)
                    base, pieces, held = base + made.num_rows, [], 0
                    yield from (made.slice(k, 512) for k in range(0, made.num_rows, 512))
        if pieces:
            made = write(base, pieces)
            yield from (made.slice(k, 512) for k in range(0, made.num_rows, 512))

    if capacity > 65_535:
        raise ValueError("positions are written in 16 bits")
    ship(docs.sparkSession)
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrices as Parquet files."""
    packed.write.parquet(path)

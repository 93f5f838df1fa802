"""Chat formatting as prefix trees: turns that conversations share from the start are written once.

A turn is a node named by its depth and two hashes of all turns up to it.
Distinct conversations are ordered by their paths; a node belongs to the first
conversation that has it, and nodes are written by (conversation, depth), which
is depth-first. Running sums over ranges of that order give each node its place
in the token stream. A node's position ids go on from its parent's, and its
attention intervals are the stretches of the stream that hold its ancestors and
itself.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, partitions, ship, stage
from shelfvoice.llm.token_counts import byte_alphabet
from shelfvoice.llm.token_ids import encode
from shelfvoice.operators.joins import lookup_left

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns by which conversations are ordered; beyond them shared turns are still written once, before what follows them.
PATH_TURNS = 64
_BLOCK = 4096


def escape(text: str) -> str:
    """No control string can stand in the result."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n;")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n;|.)", lambda m: "\n" if m[1] == "n;" else m[1], role, flags=re.S)


@lru_cache(2)
def token_bytes(path: str) -> dict[int, bytes]:
    """Bytes of each token id."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    out = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
    return out | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows with their place in the conversation and the hashes of the prefix and of the whole."""
    rows = conversations.select(
        col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"),
        F.coalesce(col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(col("text").cast("string"), F.lit("")).alias("text"),
    )
    own = Window.partitionBy("conv_id")
    placed = rows.withColumn("depth", F.row_number().over(own.orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    so_far = own.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = placed.withColumns({"a": F.xxhash64(F.lit(1), "depth", "role", "text"), "b": F.xxhash64("text", "role", "depth", F.lit(2))})
    name = lambda n, a, b: F.concat_ws(":", n, F.hex(a), F.hex(b))
    return hashed.select(
        "conv_id", "depth", "role", "text",
        name(F.col("depth"), F.bit_xor("a").over(so_far), F.bit_xor("b").over(so_far)).alias("node"),
        name(F.count(F.lit(1)).over(own), F.bit_xor("a").over(own), F.bit_xor("b").over(own)).alias("leaf"),
    )


def _segments(rows: DataFrame, path: str) -> DataFrame:
    """Add each turn's token ids and the part of them under the loss mask."""

    def run(batches):
        for batch in batches:
            roles, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            heads = encode([f"{OPEN}{escape_role(r)}\n" for r in roles], path)
            bodies, feet = encode([escape(t) for t in texts], path), encode([f"{CLOSE}\n"] * len(texts), path)
            ids, lo, hi = [], [], []
            for role, h, b, f in zip(roles, heads, bodies, feet):
                ids.append(h + b + f)
                lo.append(len(h) // 4 if role == "assistant" else 0)
                hi.append((len(h) + len(b)) // 4 if role == "assistant" else 0)
            n = [len(x) // 4 for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), pa.array(ids, pa.binary()), pa.array(n, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                ["leaf", "depth", "node", "role", "ids", "n_tokens", "loss_from", "loss_to"],
            )

    return rows.select("leaf", "depth", "node", "role", "text").mapInArrow(run, "leaf string, depth int, node string, role string, ids binary, n_tokens int, loss_from int, loss_to int")


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Stage the rows ordered, with a number ``place`` that grows along the order and has the range in its upper bits."""
    parts = partitions(df.sparkSession)
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return stage(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")


def format_trees(conversations: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Format ``conversations(conv_id, turn, role, text)``; returns nodes and conversations.

    Nodes: ``node, parent, depth, role, ids`` (little-endian unsigned 32-bit),
    ``n_tokens, loss_from, loss_to`` (tokens of ``ids`` under the loss mask:
    assistant texts), ``start`` (place in the stream), ``position`` (position id
    of its first token: the tokens of its ancestors) and ``intervals`` (stretches
    of the stream it attends to, itself last). Conversations: ``conv_id, node``
    (the last turn's), ``n_turns``.

    Turns are ordered by ``turn``, then role and text; null roles and texts are
    empty; repeated rows are turns of their own; rows without conv_id form one
    conversation; other columns are not read; empty in, empty out.
    """
    ship(conversations.sparkSession)
    turns = stage(_turns(conversations), "turns")
    ends = turns.groupBy("conv_id").agg(F.max("leaf").alias("node"), F.count(F.lit(1)).alias("n_turns"))
    # Copies of a conversation go together here, before anything is encoded.
    paths = turns.groupBy("leaf", "depth").agg(F.first("node").alias("node"), F.first("role").alias("role"), F.first("text").alias("text"))
    rows = stage(_segments(paths, path), "segments")
    # Places are found on narrow rows; token ids are joined in at the end, moving once.
    steps = rows.select("leaf", "depth", "node", "n_tokens")
    order = steps.filter(F.col("depth") <= PATH_TURNS).groupBy("leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]), "/").alias("path"))
    ranks = _in_order(order, "path", "leaf").select("leaf", F.col("place").alias("rank"))
    ranked = steps.join(ranks, "leaf")
    owners = ranked.groupBy("node", "depth").agg(F.min("rank").alias("owner"), F.max("n_tokens").alias("n_tokens"))
    placed = _in_order(owners, "owner", "depth").withColumn("part", F.shiftright("place", 33))
    sizes = placed.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.broadcast(sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base")))  # a row for each range
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.join(bases, "part").select("node", "owner", (F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("start"))
    known = lookup_left(ranked, stage(starts, "starts"), "node", F.xxhash64("leaf", "depth"))
    content = rows.select("leaf", "depth", "role", "ids", "loss_from", "loss_to")
    nodes = _with_intervals(known).join(content, ["leaf", "depth"])
    return nodes.select("node", "parent", "depth", "role", "ids", "n_tokens", "loss_from", "loss_to", "start", "position", "intervals"), ends


def _with_intervals(rows: DataFrame) -> DataFrame:
    """Walk each path: positions are sums, intervals are joined where one ancestor ends and the next begins."""
    walk = Window.partitionBy("leaf").orderBy("depth")
    so_far = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = walk.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n_tokens")
    out = rows.withColumns({"parent": F.lag("node").over(walk), "position": F.coalesce(F.sum("n_tokens").over(past), F.lit(0)), "last_end": F.lag(end).over(walk)})
    out = out.withColumn("opens", F.col("last_end").isNull() | (F.col("last_end") != F.col("start")))
    out = out.withColumn("since", F.last(F.when(F.col("opens"), F.col("start")), ignorenulls=True).over(so_far))
    out = out.withColumn("closed", F.when(F.col("opens") & F.col("last_end").isNotNull(), F.struct(F.lag("since").over(walk).alias("from"), F.col("last_end").alias("to"))))
    mine = F.array(F.struct(F.col("since").alias("from"), end.alias("to")))
    out = out.withColumn("intervals", F.concat(F.collect_list("closed").over(so_far), mine)).filter(F.col("rank") == F.col("owner"))
    return out.select("leaf", "node", "parent", "depth", "n_tokens", "start", "position", "intervals")


def read_back(nodes: DataFrame, ends: DataFrame, path: str) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from the written nodes alone.

    The intervals of a conversation's last node are joined with the nodes that
    begin in them, block by block; each path is then streamed in order through
    the parser, so memory does not grow with its length. Copies are read once.
    """
    last = nodes.join(ends.select("node").distinct(), "node", "left_semi")
    spans = last.select(F.col("node").alias("leaf"), F.explode("intervals").alias("i"))
    block: Column = F.floor(F.col("start") / _BLOCK)
    spans = spans.select("leaf", "i.from", "i.to", F.explode(F.sequence(F.floor(F.col("i.from") / _BLOCK), F.floor((F.col("i.to") - 1) / _BLOCK))).alias("block"))
    content = nodes.select("start", "ids", "loss_from", "loss_to", block.alias("block"))
    found = spans.join(content, "block").filter((F.col("start") >= F.col("from")) & (F.col("start") < F.col("to")))
    ordered = found.repartition("leaf").sortWithinPartitions("leaf", "start").select("leaf", "ids", "loss_from", "loss_to")
    digests = stage(ordered.mapInArrow(_parsed(path), "leaf string, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"), "digests")
    joined = lookup_left(ends, digests.withColumnRenamed("leaf", "node"), "node", F.col("conv_id"))
    return joined.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def parse_turn(text: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    head, body = text[len(OPEN) :].split("\n", 1)
    foot = f"{CLOSE}\n"
    if not text.startswith(OPEN) or not body.endswith(foot) or OPEN in body or CLOSE in body[: -len(foot)]:
        raise ValueError("not one formatted turn")
    return unescape_role(head), unescape(body[: -len(foot)])


def _parsed(path: str):
    def run(batches):
        word = token_bytes(path)
        decode = lambda ids: b"".join(map(word.__getitem__, ids.tolist())).decode("utf-8")
        now, turns, loss, sizes = None, hashlib.sha256(), hashlib.sha256(), [0, 0]

        def made():
            values = (now, turns.hexdigest(), sizes[0], loss.hexdigest(), sizes[1])
            names = ("leaf", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            return {k: [v] for k, v in zip(names, values)}

        out: dict[str, list] = {}
        for batch in batches:
            for leaf, raw, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if leaf != now:
                    if now is not None:
                        for k, v in made().items():
                            out.setdefault(k, []).extend(v)
                    now, turns, loss, sizes = leaf, hashlib.sha256(), hashlib.sha256(), [0, 0]
                ids = np.frombuffer(raw, dtype="<u4")
                text = decode(ids)
                role, body = parse_turn(text)
                turns.update(f"{role}\n{body}\n".encode())
                sizes[1] += len(text)
                if hi:
                    under = unescape(decode(ids[lo:hi]))
                    loss.update(under.encode())
                    sizes[0] += len(under)
            if out:
                yield pa.RecordBatch.from_pydict(out)
                out = {}
        if now is not None:
            yield pa.RecordBatch.from_pydict(made())

    return run

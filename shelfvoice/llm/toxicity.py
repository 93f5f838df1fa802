"""Toxicity: a bidirectional gated recurrent network with attention pooling, over overlapping windows.

A word enters as a learned vector of its hashed form and the mean of learned
vectors of its hashed character trigrams. Two gated recurrent layers read a
window in both directions, attention pools their states, and a logistic unit
scores the window; a document's score is that of its worst window. Training is
plain numpy on a bounded sample of windows of labelled documents: labels belong
to documents, so after a first pass over all windows the network is trained on
the windows that it finds worst in each document.

A worker computes a word's share of the gates once for all places where the word
stands, and steps all windows of a slice of texts together.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, ship
from shelfvoice.llm.presplit import grouped

WORD = re.compile(r"[^\W_]+")
#: Words of a window, and from one window's start to the next's.
WINDOW, STRIDE = 32, 28
WORD_BUCKETS, WORD_SIZE = 1 << 14, 8
GRAM_BUCKETS, GRAM_SIZE = 1 << 14, 12
HIDDEN, ATTENTION = 8, 8
#: Bounds of the training sample: labelled documents of each class, and windows of one document.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WINDOWS = 1000, 2000, 30
THRESHOLD = 0.7
#: Parts of the sample for counting labels apart; share of words that keep their learned vector in a training step.
FOLDS, KEPT = 5, 0.5
_BATCH = 2048


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_starts(n: int) -> range:
    """Starts of the windows of n words; all words are covered and neighbours overlap."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


class Words(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, buckets of all its trigrams on end, and where each word's trigrams begin."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = points == 10
    # Trigrams centred on each character; line ends stand for the word's bounds.
    mid = np.flatnonzero(~ends)
    gram = points[mid - 1] * np.uint64(0x9E3779B97F4A7C15) + points[mid] * np.uint64(0xC2B2AE3D27D4EB4F) + points[mid + 1] * np.uint64(0x165667B19E3779F9)
    gram = ((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % GRAM_BUCKETS
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(words) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(mid)) - np.repeat(first, sizes)
    mixed = points[mid] * (np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    mixed ^= mixed >> np.uint64(31)
    total = np.add.reduceat(mixed, first) if len(words) else np.zeros(0, dtype=np.uint64)
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((total >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS), gram, first


def new_model(seed: int) -> dict[str, np.ndarray]:
    rnd, size = np.random.default_rng(seed), WORD_SIZE + GRAM_SIZE + 3
    draw = lambda *shape, by=1.0: (rnd.standard_normal(shape) * by).astype(np.float32)
    return {
        "word": draw(WORD_BUCKETS, WORD_SIZE, by=0.1),
        "gram": draw(GRAM_BUCKETS, GRAM_SIZE, by=0.3),
        "seen_word": np.zeros(WORD_BUCKETS, dtype=np.float32),
        "seen_gram": np.zeros(GRAM_BUCKETS, dtype=np.float32),
        "wx": draw(size, 6 * HIDDEN, by=size**-0.5),
        "bx": np.zeros(6 * HIDDEN, dtype=np.float32),
        "u": draw(2, HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5),
        "a": draw(2 * HIDDEN, ATTENTION, by=(2 * HIDDEN) ** -0.5),
        "a0": np.zeros(ATTENTION, dtype=np.float32),
        "v": draw(ATTENTION, by=ATTENTION**-0.5),
        "w": draw(2 * HIDDEN, by=(2 * HIDDEN) ** -0.5),
        "b": np.zeros(1, dtype=np.float32),
        "scale": np.array([1.0, 0.0]),
    }


def surprise(words: list[str], ids: np.ndarray, doc: np.ndarray, label: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket of words and of trigrams how far its share of toxic documents among ``use`` exceeds chance, in deviations."""
    bucket, gram, first = features(words)
    sizes = np.diff(np.concatenate((first, [len(gram)])))
    place, at = np.nonzero((ids >= 0) & use[doc][:, None])
    pairs = np.unique(doc[place] * len(words) + ids[place, at])
    d, w = pairs // len(words), pairs % len(words)
    rate = label[use].mean() if use.any() else 0.0
    out = []
    for buckets, of, who in ((WORD_BUCKETS, bucket[w], d), (GRAM_BUCKETS, gram[np.repeat(first[w], sizes[w]) + _counts(sizes[w])], np.repeat(d, sizes[w]))):
        own = np.unique(who * buckets + of)
        who, of = own // buckets, own % buckets
        n, hits = np.bincount(of, minlength=buckets), np.bincount(of, weights=label[who], minlength=buckets)
        known = np.clip((hits - n * rate) / np.sqrt(np.maximum(n, 1) * rate * (1 - rate) + 0.25) / 4, -3, 3)
        out.append(np.where(n < 3, 0, known).astype(np.float32))
    return out[0], out[1]


def _counts(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def embed(m: dict, words: list[str]):
    bucket, gram, first = features(words)
    sizes = np.diff(np.concatenate((first, [len(gram)]))).astype(np.float32)
    if not words:
        return np.zeros((0, WORD_SIZE + GRAM_SIZE + 3), np.float32), (bucket, gram, first, sizes)
    chars = np.add.reduceat(m["gram"][gram], first, axis=0) / sizes[:, None]
    seen = m["seen_gram"][gram]
    peak, level = np.maximum.reduceat(seen, first), np.add.reduceat(seen, first) / sizes
    return np.concatenate((m["word"][bucket], chars, m["seen_word"][bucket, None], peak[:, None], level[:, None]), axis=1), (bucket, gram, first, sizes)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(m: dict, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
    """Logits of windows ``ids`` (windows x places, -1 for no word); ``gates`` has a row per word, the last one zero."""
    n, places = ids.shape
    h = np.zeros((2, n, HIDDEN), dtype=np.float32)
    states, kept = np.zeros((places, n, 2 * HIDDEN), dtype=np.float32), []
    there = (ids >= 0).astype(np.float32)
    split = 3 * HIDDEN
    for k in range(places):
        back = places - 1 - k
        x = np.stack((gates[ids[:, k], :split], gates[ids[:, back], split:]))
        on = np.stack((there[:, k], there[:, back]))[:, :, None]
        y = np.matmul(h, m["u"])
        zr = _sigmoid(x[:, :, : 2 * HIDDEN] + y[:, :, : 2 * HIDDEN])
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        new = np.tanh(x[:, :, 2 * HIDDEN :] + r * y[:, :, 2 * HIDDEN :])
        step = on * (1 - z)
        if keep:
            kept.append((h, y, z, r, new, on))
        h = h + step * (new - h)
        states[k, :, :HIDDEN] = h[0]
        states[back, :, HIDDEN:] = h[1]
    t = np.tanh(states @ m["a"] + m["a0"])
    s = np.where(there.T > 0, t @ m["v"], -1e9)
    e = np.exp(s - s.max(axis=0)) * there.T
    weight = e / np.maximum(e.sum(axis=0), 1e-9)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    logit = pooled @ m["w"] + m["b"][0]
    return (logit, (states, kept, t, weight, pooled)) if keep else logit


def gradients(m: dict, words: list[str], ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, hold: np.ndarray | None = None) -> tuple[dict, float]:
    """Gradients of the weighted logistic loss; ``hold`` scales each word's learned vector (dropout)."""
    x, (bucket, gram, first, sizes) = embed(m, words)
    if hold is not None:
        x[:, : WORD_SIZE + GRAM_SIZE] *= hold[:, None]
    gates = np.concatenate((x @ m["wx"] + m["bx"], np.zeros((1, 6 * HIDDEN), np.float32)))
    logit, (states, kept, t, weight, pooled) = forward(m, gates, ids, keep=True)
    p = _sigmoid(logit)
    d = ((p - labels) * weights / len(labels)).astype(np.float32)
    g = {"w": pooled.T @ d, "b": d.sum(keepdims=True)}
    d_pooled = d[:, None] * m["w"]
    d_weight = (states * d_pooled).sum(axis=2)
    d_states = weight[:, :, None] * d_pooled
    d_s = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_t = d_s[:, :, None] * m["v"] * (1 - t * t)
    g["v"] = np.tensordot(d_s, t, axes=((0, 1), (0, 1)))
    g["a"] = np.tensordot(states, d_t, axes=((0, 1), (0, 1)))
    g["a0"] = d_t.sum(axis=(0, 1))
    d_states += d_t @ m["a"].T
    places, split = ids.shape[1], 3 * HIDDEN
    g["u"], d_gates = np.zeros_like(m["u"]), np.zeros_like(gates)
    d_h = np.zeros((2, len(ids), HIDDEN), dtype=np.float32)
    for k in range(places - 1, -1, -1):
        back = places - 1 - k
        h, y, z, r, new, on = kept[k]
        d_h += np.stack((d_states[k, :, :HIDDEN], d_states[back, :, HIDDEN:]))
        d_new = d_h * on * (1 - z) * (1 - new * new)
        d_z = d_h * on * (h - new) * z * (1 - z)
        d_r = d_new * y[:, :, 2 * HIDDEN :] * r * (1 - r)
        d_x = np.concatenate((d_z, d_r, d_new), axis=2)
        d_y = np.concatenate((d_z, d_r, d_new * r), axis=2)
        g["u"] += np.matmul(h.transpose(0, 2, 1), d_y)
        d_h = d_h * (1 - on * (1 - z)) + np.matmul(d_y, m["u"].transpose(0, 2, 1))
        np.add.at(d_gates[:, :split], ids[:, k], d_x[0])
        np.add.at(d_gates[:, split:], ids[:, back], d_x[1])
    d_gates = d_gates[:-1]
    g["wx"], g["bx"] = x.T @ d_gates, d_gates.sum(axis=0)
    d_in = d_gates @ m["wx"].T
    if hold is not None:
        d_in = d_in * hold[:, None]
    g["word"], g["gram"] = np.zeros_like(m["word"]), np.zeros_like(m["gram"])
    np.add.at(g["word"], bucket, d_in[:, :WORD_SIZE])
    np.add.at(g["gram"], gram, np.repeat(d_in[:, WORD_SIZE : WORD_SIZE + GRAM_SIZE] / sizes[:, None], sizes.astype(np.int64), axis=0))
    loss = float((weights * (np.logaddexp(0, logit) - labels * logit)).mean())
    return g, loss


def window_ids(windows: list[str]) -> tuple[list[str], np.ndarray]:
    """Distinct words and the windows' word numbers."""
    number = Words()
    ids = np.full((len(windows), WINDOW), -1, dtype=np.int32)
    for k, window in enumerate(windows):
        own = window.split()
        ids[k, : len(own)] = [number[w] for w in own]
    return list(number), ids


def score_windows(m: dict, words: list[str], ids: np.ndarray) -> np.ndarray:
    x, _ = embed(m, words)
    gates = np.concatenate((x @ m["wx"] + m["bx"], np.zeros((1, 6 * HIDDEN), np.float32)))
    return np.concatenate([forward(m, gates, ids[k : k + _BATCH]) for k in range(0, len(ids), _BATCH)] or [np.zeros(0, np.float32)])


def calibrated(worst: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic fit of documents' worst windows."""
    w = np.full(len(label), 1 / len(label))
    x = np.stack((worst, np.ones(len(worst))), axis=1).astype(np.float64)
    at = np.array([1.0, -np.median(worst)])
    for _ in range(60):
        p = _sigmoid(x @ at)
        slope = x.T @ (w * (p - label)) + 1e-3 * np.array([at[0] - 1, 0])
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        at = at - np.clip(np.linalg.solve(bend, slope), -2, 2)
    return at


def train(windows: list[str], doc: np.ndarray, label: np.ndarray, seed: int = 7, rounds: int = 6, rate: float = 0.01) -> dict[str, np.ndarray] | None:
    """Fit on windows; ``doc`` numbers their documents, ``label`` is by document. One class only: None."""
    if len(set(label.tolist())) < 2:
        return None
    m, rnd = new_model(seed), np.random.default_rng(seed)
    mean, square, steps = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    words, ids = window_ids(windows)
    # What labels say of a word is counted without the documents of the fold being trained on.
    fold = np.arange(len(label)) % FOLDS
    tables = [surprise(words, ids, doc, label, fold != k) for k in range(FOLDS)]

    def score_folds() -> np.ndarray:
        out = np.zeros(len(windows), dtype=np.float32)
        for k in range(FOLDS):
            m["seen_word"], m["seen_gram"] = tables[k]
            own = np.flatnonzero(fold[doc] == k)
            out[own] = score_windows(m, words, ids[own])
        return out

    toxic = label[doc] == 1
    share = toxic.mean()
    use = np.arange(len(windows))
    for turn in range(rounds):
        if turn:  # the worst windows of each document, and some others of clean ones
            worth = score_folds() + rnd.random(len(windows)) * 1e-3
            order = np.lexsort((-worth, doc))
            rank = np.empty(len(windows), dtype=np.int64)
            begin = np.searchsorted(doc[order], np.arange(len(label)))
            rank[order] = np.arange(len(windows)) - begin[doc[order]]
            use = np.flatnonzero(np.where(toxic, rank < 2, (rank < 4) | (rnd.random(len(windows)) < 0.15)))
            share = toxic[use].mean()
        rnd.shuffle(use)
        batch = 256 if len(use) > 4000 else 64
        lots = [own[at : at + batch] for own in (use[fold[doc[use]] == k] for k in range(FOLDS)) for at in range(0, len(own), batch)]
        for lot in rnd.permutation(len(lots)):
            part = lots[lot]
            m["seen_word"], m["seen_gram"] = tables[fold[doc[part[0]]]]
            own, local = np.unique(ids[part], return_inverse=True)
            local = local.reshape(len(part), WINDOW)
            if own[0] < 0:
                own, local = own[1:], local - 1
            y = toxic[part].astype(np.float32)
            g, _ = gradients(m, [words[k] for k in own], local, y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32), (rnd.random(len(own)) < KEPT).astype(np.float32) / KEPT)
            steps += 1
            norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
            for k, v in g.items():  # what was counted from labels and the scale are not trained
                v = v * min(1.0, 1.0 / max(norm, 1e-6))
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                m[k] -= (rate * 0.2 if k in ("word", "gram") else rate) * (1 - turn / (rounds + 1)) * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.99**steps)) + 1e-6)
    worst = np.full(len(label), -np.inf)
    np.maximum.at(worst, doc, score_folds())
    m["scale"] = calibrated(worst, label)
    m["seen_word"], m["seen_gram"] = surprise(words, ids, doc, label, np.ones(len(label), dtype=bool))
    return m


def score_texts(m: dict | None, texts: list[str]) -> np.ndarray:
    """Score of each whole text: that of its worst window; no words: one empty window."""
    if m is None:
        return np.full(len(texts), 0.5)
    out = np.zeros(len(texts))
    for a, b in grouped(texts, 1_500_000):
        number = Words()
        flat: list[int] = []
        begins, sizes = [], []
        for t in texts[a:b]:
            own = words_of(t)
            starts = window_starts(len(own))
            begins += [len(flat) + s for s in starts]
            sizes.append(len(starts))
            flat += map(number.__getitem__, own)
            flat += [-1] * WINDOW  # short and last windows run into places without words
        flat_ids = np.array(flat, dtype=np.int64)
        ids = flat_ids[np.array(begins)[:, None] + np.arange(WINDOW)]
        ids = np.where(np.minimum.accumulate(ids, axis=1) < 0, -1, ids)
        logits = score_windows(m, list(number), ids)
        worst = np.maximum.reduceat(logits, np.concatenate(([0], np.cumsum(sizes)[:-1])))
        out[a:b] = _sigmoid(m["scale"][0] * worst.astype(np.float64) + m["scale"][1])
    return out


def remainder(id_col: str):
    return F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(3))


def sample_windows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, windows: int = SAMPLE_WINDOWS):
    """Windows of a bounded sample of labelled documents on the driver: their words, document numbers, labels.

    Documents are taken by a hash of the id, so the choice depends neither on
    order nor on partitions. Those held out (remainder 1) are never taken.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = words_of(text or "")
                starts = window_starts(len(own))
                step = max(1, -(-len(starts) // windows))
                rows += [(doc, y, " ".join(own[s : s + WINDOW])) for s in starts[::step]]
            kinds = (pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, kinds)], ["doc_id", "y", "window"])

    ship(docs.sparkSession)
    known = labels.select(col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(remainder("doc_id") != 1).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("draw", F.xxhash64("doc_id"))
    some = known.filter("y = 1").orderBy("draw", "doc_id").limit(toxic).unionByName(known.filter("y = 0").orderBy("draw", "doc_id").limit(clean))
    source = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    chosen = source.join(F.broadcast(some.drop("draw")), "doc_id").select("doc_id", "text", "y")  # at most toxic + clean ids
    rows = sorted(chosen.mapInArrow(run, "doc_id long, y int, window string").distinct().collect())
    ids = sorted({r[0] for r in rows})
    number = {d: k for k, d in enumerate(ids)}
    label = np.zeros(len(ids), dtype=np.int64)
    for d, y, _ in rows:
        label[number[d]] = y
    return [r[2] for r in rows], np.array([number[r[0]] for r in rows], dtype=np.int64), label


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> dict[str, np.ndarray] | None:
    return train(*sample_windows(docs, labels, id_col, text_col), seed=seed)


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Null and empty texts are scored as a window without words. A null id is not
    held out. Without a model (labels of one class or none) every score is 0.5.
    Repeated rows score alike; other columns are not read; one narrow pass.
    """

    def run(batches):
        for batch in batches:
            got = score_texts(model, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    ship(docs.sparkSession)
    source = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns; without a model all of them."""
    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(model, [t or "" for t in texts]))

    ship(docs.sparkSession)
    return docs if model is None else docs.filter(toxic(col(text_col).cast("string")) < THRESHOLD)

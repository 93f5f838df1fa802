"""Enrichment of text columns by a caller's batch function.

The caller passes ``fn(list[str]) -> list[str]`` (a translator, a labelling
model). Spark reduces the work to distinct texts, drops what a cache already
holds, calls ``fn`` from the executors, stores every outcome once and joins the
values back to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfvoice.functions.numbers import percent
from shelfvoice.functions.text import (
    ERROR_CLASSES,
    cache_key,
    chunk_text,
    clean_output,
    error_class,
    nonblank,
    normalise_text,
    preview_text,
    render_prompt,
    trim_text,
)
from shelfvoice.operators.cache import append_results, for_keys, read_cache, valid_entries
from shelfvoice.operators.joins import fits_broadcast, lookup_left
from shelfvoice.schema import CACHE_TTL_DAYS, ERROR_PREVIEW_CHARS, MAX_RETRIES, RETRY_PAUSE_SECONDS, require_columns
from shelfvoice.sources.workspace import stage, stage_rounds

#: Classes of failure that a repeat cannot mend, and those that pass if calls slow down.
PERMANENT, SLOWED = ("unauthorized", "not_found"), ("rate_limited", "timeout")
BatchFunction = Callable[[list[str]], list[str]]
#: Parts of the key hash that rounds are made of.
_SLOTS = 1 << 40
_CALL_SCHEMA = "cache_key string, outputs array<string>, message string"


class Enriched(NamedTuple):
    """Rows with their new columns, and one log row per row and column."""

    rows: DataFrame
    log: DataFrame


@dataclass(frozen=True)
class LabelTask:
    name: str
    col_name: str
    prompt: str
    source_col: str


@dataclass(frozen=True)
class CallOptions:
    """How ``fn`` is called. ``max_callers`` is the number of tasks that call; default: one a core.

    ``interval`` is the least time in seconds from one call of a task to its
    next, so ``max_callers / interval`` bounds the calls a second. After a rate
    limit or a timeout each further pause is ``growth`` times the last.
    Work goes in rounds of about ``round_texts`` texts. A round's outcomes are
    written, and its successes cached, before the next begins, so a lost task
    repeats only its share of one round and a job that ends early only that round.
    """

    batch_size: int = 64
    max_retries: int = MAX_RETRIES
    pause: float = RETRY_PAUSE_SECONDS
    max_callers: int | None = None
    interval: float = 0.0
    growth: float = 2.0
    round_texts: int = 100_000


def call_function(work: DataFrame, fn: BatchFunction, options: CallOptions) -> DataFrame:
    """Run ``fn`` over ``(cache_key, pieces)``; a failure is data, the job goes on.

    Texts are sent in batches. If a batch fails, its texts are tried one by one,
    each up to ``max_retries`` times, so only texts that really fail are lost;
    what a repeat cannot mend (``PERMANENT``) is not repeated. An answer that is
    missing or no text is a failure too. The work is dealt over a fixed number of
    tasks, so that a few short texts are not called from one.
    """
    # Plain values: workers then need nothing of this package to load the function.
    batch_size, max_retries, pause = options.batch_size, options.max_retries, options.pause
    interval, growth = options.interval, options.growth
    marks, permanent, slowed = list(ERROR_CLASSES), set(PERMANENT), set(SLOWED)

    def run(frames):
        import time

        import pandas as pd

        last = [float("-inf")]

        def call(texts):
            if interval:
                time.sleep(max(0.0, last[0] + interval - time.monotonic()))
                last[0] = time.monotonic()
            out = list(fn(texts))
            if len(out) != len(texts):
                raise ValueError(f"expected {len(texts)} results, got {len(out)}")
            if not all(isinstance(o, str) for o in out):
                raise ValueError("an answer is missing or not a text")
            return out

        def one(pieces):
            for attempt in range(max_retries):
                try:
                    return call(pieces), None
                except Exception as problem:  # noqa: BLE001 - any failure becomes data
                    message = str(problem) or type(problem).__name__
                    kind = next((name for mark, name in marks if mark in message.lower()), "other")
                    if kind in permanent:
                        break
                    if attempt + 1 < max_retries:
                        time.sleep(pause * growth**attempt if kind in slowed else pause)
            return None, message

        def batch(group):
            try:
                flat = iter(call([p for pieces in group for p in pieces]))
                return [([next(flat) for _ in pieces], None) for pieces in group]
            except Exception:  # noqa: BLE001
                return [one(pieces) for pieces in group]

        for frame in frames:
            texts = [list(p) for p in frame["pieces"]]
            done = []
            for i in range(0, len(texts), batch_size):
                done += batch(texts[i : i + batch_size])
            yield pd.DataFrame(
                {
                    "cache_key": frame["cache_key"],
                    "outputs": pd.Series([d[0] for d in done], index=frame.index, dtype=object),
                    "message": pd.Series([d[1] for d in done], index=frame.index, dtype=object),
                }
            )

    callers = options.max_callers or work.sparkSession.sparkContext.defaultParallelism
    return work.repartition(callers, "cache_key").mapInPandas(run, _CALL_SCHEMA)


def _known(asked: DataFrame, cache: DataFrame, now, ttl_days: float) -> DataFrame:
    """Distinct requested keys with their cached value; NULL where none is valid."""
    keys = stage(asked.select("cache_key").distinct(), "asked-keys")
    valid = valid_entries(for_keys(cache, keys), now, ttl_days).select("cache_key", "value")
    return stage(keys.join(valid, "cache_key", "left"), "known")


def _texts_of(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct texts of some keys. Few keys are sought by broadcast, before any text is shuffled."""
    if fits_broadcast(keys):
        return asked.join(F.broadcast(keys), "cache_key", "left_semi").distinct()
    return asked.distinct().join(keys, "cache_key", "left_semi")


def _resolve(
    asked: DataFrame,
    pieces: Column,
    fn: BatchFunction,
    finish: Callable[[Column], Column],
    options: CallOptions,
    cache: DataFrame | None,
    cache_path: str | None,
    now,
    ttl_days: float,
) -> DataFrame:
    """Outcome of each distinct requested ``(cache_key, text)``, staged so that no call runs twice.

    The table at ``cache_path`` is read before any call, as far as its days are
    valid, and gets the new results afterwards. It need not exist yet.
    """
    if cache_path is not None:
        stored = read_cache(asked.sparkSession, cache_path, now, ttl_days).select("cache_key", "value", "written_at", "status")
        cache = stored if cache is None else _with_status(cache).unionByName(stored)
    if cache is None:
        work, hits = asked.distinct(), None
    else:
        known = _known(asked, cache, now, ttl_days)
        work = _texts_of(asked, known.filter("value IS NULL").select("cache_key"))
        hits = known.filter("value IS NOT NULL").select(
            "cache_key", "value", F.lit("cached").alias("status"), F.lit(None).cast("string").alias("error_class")
        )
    def answered(texts: DataFrame) -> DataFrame:
        called = call_function(texts, fn, options)
        return called.select(
            "cache_key",
            F.when(F.col("message").isNull(), finish(F.array_join("outputs", " "))).alias("value"),
            F.when(F.col("message").isNull(), "done").otherwise("failed").alias("status"),
            error_class(F.col("message")).alias("error_class"),
        )

    def store(outcomes: DataFrame) -> None:
        if cache_path is not None:
            append_results(outcomes, cache_path, now)

    rounds = _rounds(work.select("cache_key", pieces.alias("pieces")), options.round_texts)
    new = stage_rounds((answered(texts) for texts in rounds), "enriched", store)
    return new if hits is None else hits.unionByName(new)


def _rounds(work: DataFrame, round_texts: int) -> Iterable[DataFrame]:
    """The work in parts of about ``round_texts`` rows by a hash of the key; one part if there is little or none.

    It is written once, sorted by the hash inside each file, so that a round
    reads its own pages and not all of the work.
    """
    slots = work.withColumn("_slot", F.pmod(F.xxhash64("cache_key"), F.lit(_SLOTS)))
    slots = stage(slots.sortWithinPartitions("_slot"), "work")
    n = max(1, ceil(slots.count() / round_texts))
    for i in range(n):
        mine = (F.col("_slot") >= _SLOTS * i // n) & (F.col("_slot") < _SLOTS * (i + 1) // n)
        yield slots.filter(mine).drop("_slot")


def _with_status(cache: DataFrame) -> DataFrame:
    """A cache frame without a status holds successes."""
    status = F.col("status") if "status" in cache.columns else F.lit("done")
    return cache.select("cache_key", "value", "written_at", status.alias("status"))


def _value(status: Column, value: Column, head: Column) -> Column:
    """Blank requests (no status) are empty, failures carry the start of their text."""
    failed = F.concat(F.lit("[error: "), head, F.lit("]"))
    return F.when(status.isNull(), F.lit("")).when(status == "failed", failed).otherwise(value)


@dataclass(frozen=True)
class _Request:
    """Names of the new column and of the helper columns that ask for it."""

    target: str
    source: str
    key: str  # NULL where the source is blank
    text: str  # what is sent
    shown: str  # what a failure shows


def _asked(keyed: DataFrame, requests: list[_Request]) -> DataFrame:
    """``(cache_key, text)`` of all requests that are not blank, copies included."""
    if len(requests) == 1:
        [r] = requests
        # Tested on the source: a test of the key would be pushed below the
        # normalisation and repeat it.
        spoken = keyed.filter(nonblank(F.col(f"`{r.source}`").cast("string")))
        return spoken.select(F.col(r.key).alias("cache_key"), F.col(r.text).alias("text"))
    pairs = F.array(*[F.struct(F.col(r.key).alias("cache_key"), F.col(r.text).alias("text")) for r in requests])
    return keyed.select(F.explode(pairs).alias("p")).select("p.*").filter("cache_key IS NOT NULL")


def _attach(keyed: DataFrame, columns: list[str], requests: list[_Request], outcome: DataFrame, id_col: str) -> Enriched:
    """Join outcomes back to the rows, of which ``columns`` are kept.

    A copied text may stand for a large part of the rows, so the join splits hot
    keys by row id. One column is joined straight to the rows. Several columns
    travel as short ``(id, column, key)`` rows and the wide rows shuffle once.
    """
    found = outcome.select(
        F.col("cache_key").alias("_key"),
        F.col("value").alias("_value"),
        F.col("status").alias("_status"),
        F.col("error_class").alias("_error"),
    )
    answer = _value(F.col("_status"), F.col("_value"), F.col("_head"))
    log_columns = [
        F.col("_key").alias("cache_key"),
        F.coalesce("_status", F.lit("blank")).alias("status"),
        F.col("_error").alias("error_class"),
    ]
    # A column that is made again is replaced.
    made = {r.target.lower() for r in requests}
    kept = [F.col(f"`{c}`") for c in columns if c.lower() not in made]

    def head(r: _Request) -> Column:
        return preview_text(F.col(r.shown), ERROR_PREVIEW_CHARS).alias("_head")

    if len(requests) == 1:
        [r] = requests
        asked = keyed.select(*kept, F.col(r.key).alias("_key"), head(r))
        answered = lookup_left(asked, found, "_key", F.col(id_col))
        rows = answered.select(*kept, answer.alias(r.target))
        return Enriched(rows, answered.select(id_col, F.lit(r.target).alias("target"), *log_columns))
    pairs = F.array(*[F.struct(F.lit(r.target).alias("target"), F.col(r.key).alias("_key"), head(r)) for r in requests])
    asked = keyed.select(id_col, F.explode(pairs).alias("p")).select(id_col, "p.*")
    answered = lookup_left(asked, found, "_key", F.struct(id_col, "target"))
    per_row = answered.groupBy(id_col).agg(
        *[F.max(F.when(F.col("target") == r.target, answer)).alias(r.target) for r in requests]
    )
    rows = keyed.select(*kept).join(per_row, id_col, "left")
    return Enriched(rows, answered.select(id_col, "target", *log_columns))


def enrich_columns(
    df: DataFrame,
    columns: Iterable[str],
    fn: BatchFunction,
    *,
    engine: str,
    source: str = "en",
    target: str = "zh",
    suffix: str = "_zh",
    id_col: str = "ID",
    cache: DataFrame | None = None,
    cache_path: str | None = None,
    now=None,
    ttl_days: float = CACHE_TTL_DAYS,
    options: CallOptions = CallOptions(),
) -> Enriched:
    """Add ``<column><suffix>`` with the text that ``fn`` makes of each column.

    Text is normalised and sent in sentence-bounded pieces; blank text gives an
    empty value. ``id_col`` must identify a row.
    """
    columns = list(columns)
    require_columns(df, [id_col, *columns])
    requests = [_Request(f"{c}{suffix}", c, f"_key{i}", f"_text{i}", f"_text{i}") for i, c in enumerate(columns)]
    # Two steps, so that the text is normalised once and not inside each use.
    keyed = df.withColumns({r.text: normalise_text(F.col(f"`{c}`")) for r, c in zip(requests, columns)})
    parts = [F.lit(engine), F.lit(source), F.lit(target)]
    keyed = keyed.withColumns({r.key: F.when(F.col(r.text) != "", cache_key(F.col(r.text), *parts)) for r in requests})
    asked, pieces = _asked(keyed, requests), chunk_text(F.col("text"))
    outcome = _resolve(asked, pieces, fn, clean_output, options, cache, cache_path, now, ttl_days)
    return _attach(keyed, df.columns, requests, outcome, id_col)


def label_columns(
    df: DataFrame,
    tasks: Iterable[LabelTask],
    fn: BatchFunction,
    *,
    model: str,
    id_col: str = "ID",
    cache: DataFrame | None = None,
    cache_path: str | None = None,
    now=None,
    ttl_days: float = CACHE_TTL_DAYS,
    options: CallOptions = CallOptions(),
) -> Enriched:
    """Add one column per task: what ``fn`` answers to the task's prompt for each row.

    All tasks form one job, so equal prompts are asked once even across tasks.
    """
    tasks = list(tasks)
    require_columns(df, [id_col, *[t.source_col for t in tasks]])
    requests, prompts, keys = [], {}, {}
    for i, task in enumerate(tasks):
        request = _Request(task.col_name, task.source_col, f"_key{i}", f"_prompt{i}", f"_source{i}")
        text = F.col(f"`{task.source_col}`").cast("string")
        prompts[request.shown] = text
        prompts[request.text] = render_prompt(F.lit(task.prompt), text)
        key = cache_key(F.col(request.shown), F.col(request.text), F.lit(model))
        keys[request.key] = F.when(nonblank(F.col(request.shown)), key)
        requests.append(request)
    keyed = df.withColumns(prompts).withColumns(keys)
    asked, pieces = _asked(keyed, requests), F.array("text")
    outcome = _resolve(asked, pieces, fn, trim_text, options, cache, cache_path, now, ttl_days)
    return _attach(keyed, df.columns, requests, outcome, id_col)


def read_through(
    requests: DataFrame,
    cache: DataFrame,
    fn: BatchFunction,
    *,
    cache_path: str | None = None,
    now=None,
    ttl_days: float = CACHE_TTL_DAYS,
    options: CallOptions = CallOptions(),
) -> DataFrame:
    """Value of each distinct ``(cache_key, text)``: cached while valid, else computed and stored."""
    asked = requests.select("cache_key", "text")
    return _resolve(asked, F.array("text"), fn, lambda c: c, options, cache, cache_path, now, ttl_days)


def job_counters(log: DataFrame) -> DataFrame:
    """Requests by outcome; success counts cached and new values, blanks are left out."""
    counts = log.agg(
        F.count_if(F.col("status") == "done").alias("n_done"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "cached").alias("n_cached"),
        F.count_if(F.col("status") == "blank").alias("n_blank"),
    )
    good = F.col("n_done") + F.col("n_cached")
    return counts.withColumn("pct_success", percent(good, good + F.col("n_failed"), 1))

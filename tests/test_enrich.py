"""Enrichment: each distinct text once, failures as data, cache and expiry."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfvoice.operators import cache as K
from shelfvoice.operators import enrich as E
from shelfvoice.operators import joins as J

NOW = datetime(2024, 1, 31)
NO_WAIT = E.CallOptions(pause=0.0)


def recorder(folder, fail=None):
    """A function that leaves one file per text it was asked for."""
    folder = str(folder)

    def fn(texts):
        import uuid

        for t in texts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        if fail and any(fail in t for t in texts):
            raise RuntimeError(f"HTTP 429 for {fail}")
        return ["<" + t + ">" for t in texts]

    return fn


def calls(folder):
    return sorted(f.read_text() for f in folder.iterdir())


@pytest.fixture
def reviews(spark):
    rows = [(1, "same", "a"), (2, "same", "b"), (3, " same ", "c"), (4, None, "d"), (5, "  ", "e"), (6, "other", "a")]
    return spark.createDataFrame(rows, "ID long, Content string, Title string")


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_each_text_is_asked_once(reviews, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(J, "BROADCAST_MAX_ROWS", broadcast_rows)
    made = E.enrich_columns(reviews, ["Content"], recorder(tmp_path), engine="e", options=NO_WAIT)
    got = {r.ID: r.Content_zh for r in made.rows.collect()}
    assert got == {1: "<same>", 2: "<same>", 3: "<same>", 4: "", 5: "", 6: "<other>"}
    assert made.rows.columns == ["ID", "Content", "Title", "Content_zh"]
    assert made.log.count() == 6 and calls(tmp_path) == ["other", "same"]


def test_long_text_in_pieces(spark, tmp_path):
    text = "first sentence. " * 300
    df = spark.createDataFrame([(1, text)], "ID long, Content string")
    made = E.enrich_columns(df, ["Content"], recorder(tmp_path), engine="e", options=NO_WAIT)
    value = made.rows.first().Content_zh
    assert value.count("<") == 2 and all(len(c) <= 4002 for c in calls(tmp_path))


def test_one_bad_text_does_not_fail_the_batch(reviews, tmp_path):
    made = E.enrich_columns(reviews, ["Content"], recorder(tmp_path, "other"), engine="e", options=NO_WAIT)
    assert {r.ID: r.Content_zh for r in made.rows.collect()}[6] == "[error: other]"
    status = {r.ID: (r.status, r.error_class) for r in made.log.collect()}
    assert status[6] == ("failed", "rate_limited") and status[1] == ("done", None) and status[4] == ("blank", None)
    assert calls(tmp_path).count("other") >= 3
    row = E.job_counters(made.log).first()
    assert (row.n_done, row.n_failed, row.n_cached, row.n_blank, row.pct_success) == (3, 1, 0, 2, 75.0)


def failing(folder, message):
    """Leaves the time of each call and fails."""
    folder = str(folder)

    def fn(texts):
        import time
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(repr(time.monotonic()))
        raise RuntimeError(message)

    return fn


@pytest.mark.parametrize("message,asked,gaps", [("HTTP 401", 2, [0]), ("404 no such model", 2, [0]), ("HTTP 429", 4, [0, 0.2, 0.6]), ("Timeout", 4, [0, 0.2, 0.6]), ("odd", 4, [0, 0.2, 0.2])])
def test_repeats_follow_the_class_of_the_failure(spark, tmp_path, message, asked, gaps):
    """One call for the batch, then the text alone: once, or three times with pauses that grow where calls should slow down."""
    work = spark.createDataFrame([("k", ["text"])], "cache_key string, pieces array<string>")
    made = E.call_function(work, failing(tmp_path, message), E.CallOptions(pause=0.2, growth=3.0, max_retries=3)).first()
    times = sorted(float(t) for t in calls(tmp_path))
    assert made.outputs is None and made.message == message and len(times) == asked
    for a, b, least in zip(times, times[1:], gaps):
        assert least <= b - a < least + 0.35


def test_interval_between_the_calls_of_a_task(spark, tmp_path):
    work = spark.createDataFrame([(f"k{i}", [f"t{i}"]) for i in range(4)], "cache_key string, pieces array<string>")
    E.call_function(work, failing(tmp_path, "401"), E.CallOptions(batch_size=1, max_callers=1, interval=0.15)).collect()
    times = sorted(float(t) for t in calls(tmp_path))
    assert len(times) == 8 and all(b - a >= 0.149 for a, b in zip(times, times[1:]))


def test_short_answer_is_a_failure(spark):
    df = spark.createDataFrame([(1, "x")], "ID long, Content string")
    made = E.enrich_columns(df, ["Content"], lambda texts: [], engine="e", options=NO_WAIT)
    assert made.log.first().status == "failed"


def test_cache_is_used_and_only_successes_stored(spark, reviews, tmp_path):
    asked = tmp_path / "calls"
    asked.mkdir()
    path = str(tmp_path / "cache")
    settings = dict(engine="e", cache_path=path, now=NOW, options=NO_WAIT)
    E.enrich_columns(reviews, ["Content"], recorder(asked, "other"), **settings)
    stored = K.read_cache(spark, path)
    assert [r.value for r in stored.collect()] == ["<same>"]
    before = calls(asked).count("same")
    made = E.enrich_columns(reviews, ["Content"], recorder(asked), cache=stored, **settings)
    made.rows.count()
    assert calls(asked).count("same") == before
    assert {r.ID: r.status for r in made.log.collect()} == {
        1: "cached", 2: "cached", 3: "cached", 4: "blank", 5: "blank", 6: "done",
    }
    late = NOW + timedelta(days=31)
    again = E.enrich_columns(
        reviews, ["Content"], recorder(asked), engine="e", cache=K.read_cache(spark, path), now=late, options=NO_WAIT
    )
    assert {r.status for r in again.log.collect()} == {"done", "blank"}


def test_label_tasks(reviews, tmp_path):
    tasks = [
        E.LabelTask("one", "one", "Say {Content} {odd}", "Content"),
        E.LabelTask("two", "two", "Say {text}", "Title"),
        E.LabelTask("three", "three", "Say {text}", "Title"),
    ]
    made = E.label_columns(reviews, tasks, recorder(tmp_path), model="m", options=NO_WAIT)
    got = {r.ID: (r.one, r.two, r.three) for r in made.rows.collect()}
    assert got[1] == ("<Say same {odd}>", "<Say a>", "<Say a>") and got[4] == ("", "<Say d>", "<Say d>")
    assert calls(tmp_path).count("Say a") == 1


def test_retention(spark):
    cache = spark.range(100).select(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string")).alias("cache_key"),
        F.col("id").cast("string").alias("value"),
        (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.col("id").cast("int"))).alias("written_at"),
    )
    few = [r.value for r in K.retain(cache, NOW, 30, 10).orderBy(F.desc("written_at")).collect()]
    assert few == [str(i) for i in range(10)]
    assert K.retain(cache, NOW, 30, 1000).count() == 30
    assert K.retain(cache, NOW, 3000).count() == 50
    row = K.cache_report(cache, NOW, 30).first()
    assert (row.n_items, row.n_valid, row.n_expired) == (100, 30, 70)


def test_path_alone_is_a_read_through_cache(reviews, tmp_path, spark):
    path, asked_in = str(tmp_path / "cache"), tmp_path / "calls"
    asked_in.mkdir()
    run = lambda: E.enrich_columns(reviews, ["Content"], recorder(asked_in), engine="e", cache_path=path, now=NOW, options=NO_WAIT)
    first = {r.ID: r.Content_zh for r in run().rows.collect()}
    asked = len(calls(asked_in))
    again = run()
    assert {r.ID: r.Content_zh for r in again.rows.collect()} == first
    assert len(calls(asked_in)) == asked and {r.status for r in again.log.collect()} <= {"cached", "blank"}
    stored = [r.cache_key for r in K.read_cache(spark, path).collect()]
    assert len(stored) == len(set(stored)) > 0
    K.compact_cache(spark, path, NOW)
    assert K.read_cache(spark, path).count() == len(stored)
    K.clear_cache(spark, path)
    assert K.read_cache(spark, path).count() == 0
    assert K.read_cache(spark, str(tmp_path / "nowhere")).count() == 0


def test_compaction_drops_old_and_repeated_entries(spark, tmp_path):
    path = str(tmp_path / "cache")
    for day, value in ((40, "old"), (2, "second"), (1, "new")):
        K.append_results(spark.createDataFrame([("k", value, "done"), (f"k{day}", value, "done")], "cache_key string, value string, status string"), path, NOW - timedelta(days=day))
    K.compact_cache(spark, path, NOW, 30)
    assert sorted((r.cache_key, r.value) for r in K.read_cache(spark, path).collect()) == [("k", "new"), ("k1", "new"), ("k2", "second")]


def test_missing_answers_are_failures(reviews):
    made = E.enrich_columns(reviews, ["Content"], lambda texts: [None if "same" in t else t for t in texts], engine="e", options=NO_WAIT)
    log = {r.ID: r.status for r in made.log.collect()}
    rows = {r.ID: r for r in made.rows.collect()}
    failed = {i for i, s in log.items() if s == "failed"}
    assert failed == {i for i, r in rows.items() if r.Content and "same" in r.Content} and failed
    assert all(rows[i].Content_zh.startswith("[error: ") for i in failed)


def test_a_made_column_is_replaced(reviews):
    fn = lambda texts: [t + "!" for t in texts]
    once = E.enrich_columns(reviews, ["Content"], fn, engine="e", options=NO_WAIT).rows
    twice = E.enrich_columns(once, ["Content"], fn, engine="e", options=NO_WAIT).rows
    assert twice.columns == once.columns
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_many_tasks_call(spark):
    from pyspark import TaskContext

    rows = spark.range(2000).select(F.col("id").alias("ID"), F.concat(F.lit("text "), F.col("id")).alias("Content"))
    made = E.enrich_columns(rows, ["Content"], lambda texts: [str(TaskContext.get().partitionId())] * len(texts), engine="e", options=NO_WAIT)
    assert made.rows.select("Content_zh").distinct().count() == spark.sparkContext.defaultParallelism


def test_workers_need_no_package(tmp_path):
    """Started in another folder, with the package on the driver's path alone."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from shelfvoice.operators import enrich as E\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "rows = spark.createDataFrame([(1, 'a')], 'ID long, Content string')\n"
        "made = E.enrich_columns(rows, ['Content'], lambda ts: [t + '!' for t in ts], engine='e')\n"
        "print('GOT', made.rows.first().Content_zh)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "GOT a!" in out.stdout, out.stderr[-2000:]


def killing(folder, victim):
    """A recorder whose task dies, process and all, when it first meets a text."""
    record = recorder(folder / "calls")
    mark = str(folder / "killed")

    def fn(texts):
        import os

        if victim in texts and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return record(texts)

    return fn


def test_a_lost_task_repeats_no_finished_round(spark, tmp_path):
    """The first job ends with the killed task; the second finds every finished round in the cache."""
    (tmp_path / "calls").mkdir()
    df = spark.range(300).select(F.col("id").alias("ID"), F.concat(F.lit("text "), F.col("id") % 200).alias("Content"))
    options = E.CallOptions(pause=0.0, round_texts=70, max_callers=2, batch_size=1)
    path = str(tmp_path / "cache")
    fn = killing(tmp_path, "text 77")
    run = lambda: E.enrich_columns(df, ["Content"], fn, engine="e", cache_path=path, now=NOW, options=options)
    with pytest.raises(Exception, match="[Ww]orker"):
        run()
    finished = {r.value[1:-1] for r in K.read_cache(spark, path).collect()}
    first = calls(tmp_path / "calls")
    assert len(set(first) - finished) < 100 and "text 77" not in first
    got = {r.ID: r.Content_zh for r in run().rows.collect()}
    assert got == {i: f"<text {i % 200}>" for i in range(300)}
    asked = calls(tmp_path / "calls")
    assert set(asked) == {f"text {i}" for i in range(200)}
    assert all(asked.count(t) == 1 for t in finished)


def test_rounds_give_what_one_round_gives(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("ID"), F.concat(F.lit("t"), F.col("id") % 60).alias("Content"))
    many = E.enrich_columns(df, ["Content"], recorder(tmp_path, "t7"), engine="e", options=E.CallOptions(pause=0.0, round_texts=25, max_retries=1))
    assert many.rows.filter("Content_zh LIKE '<%'").count() == many.log.filter("status = 'done'").count() > 0
    assert {r.status for r in many.log.filter("ID % 60 = 7").collect()} == {"failed"} and many.log.count() == 100
    none = E.enrich_columns(df.filter("ID < 0"), ["Content"], recorder(tmp_path), engine="e", options=NO_WAIT)
    assert none.rows.count() == 0 and "Content_zh" in none.rows.columns


def test_a_round_reads_its_share_of_the_work(spark):
    work = spark.range(1000).select(F.col("id").cast("string").alias("cache_key"), F.array(F.lit("x")).alias("pieces"))
    parts = list(E._rounds(work, 100))
    keys = [{r.cache_key for r in p.collect()} for p in parts]
    assert len(parts) == 10 and sum(map(len, keys)) == len(set().union(*keys)) == 1000 and max(map(len, keys)) < 160
    assert "GreaterThanOrEqual(_slot," in parts[3]._jdf.queryExecution().toString()

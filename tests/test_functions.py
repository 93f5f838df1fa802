"""Expressions against plain Python, on fixed and generated values."""

import hashlib
import re

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfvoice.functions import numbers as N
from shelfvoice.functions import text as X

GENERATED = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
)
ALPHABET = "aZ9_é ß.\t\n 　\u0085\x1c中。，！？,5 starſ'-"
texts = st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=1, max_size=40)


def evaluate(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def py_normalise(text):
    text = " ".join(text.split())
    for phrase, short in X.STAR_TERMS:
        text = text.replace(phrase, short)
    return text


@GENERATED
@given(values=texts)
def test_trim_generated(spark, values):
    assert evaluate(spark, values, X.trim_text) == [v.strip() for v in values]


@GENERATED
@given(values=texts)
def test_words_generated(spark, values):
    expected = [re.findall(r"\b[a-z0-9]+\b", v.lower()) for v in values]
    assert evaluate(spark, values, X.tokenise) == expected


@GENERATED
@given(values=texts)
def test_normalise_generated(spark, values):
    assert evaluate(spark, values, X.normalise_text) == [py_normalise(v) for v in values]


@GENERATED
@given(values=texts)
def test_clean_output_generated(spark, values):
    def clean(v):
        for mark in "。，！？":
            v = v.replace(mark * 2, mark)
        return v

    assert evaluate(spark, values, X.clean_output) == [clean(v) for v in values]


@GENERATED
@given(values=st.lists(st.text(alphabet="ab. ", max_size=80), min_size=1, max_size=40))
def test_chunks_generated(spark, values):
    """Sentences are joined greedily while the sum stays below the limit; each is written back with its full stop."""
    limit = 15

    def chunks(text):
        if len(text) <= limit:
            return [text]
        out, now = [], ""
        for sentence in text.split(". "):
            if now and len(now) + len(sentence) >= limit:
                out.append(now.strip())
                now = ""
            now += sentence + ". "
        return [*out, now.strip()]

    values = [" ".join(v.split()) for v in values]
    assert evaluate(spark, values, lambda c: X.chunk_text(c, limit)) == [chunks(v) for v in values]


@GENERATED
@given(values=st.lists(st.floats(-10, 10) | st.none(), min_size=1, max_size=40))
def test_bucket_generated(spark, values):
    def bucket(v):
        return None if v is None else "negative" if v <= 2 else "neutral" if v <= 3 else "positive"

    assert evaluate(spark, values, N.rating_bucket, "double") == [bucket(v) for v in values]


@GENERATED
@given(values=st.lists(st.floats(0, 1000), min_size=1, max_size=40))
def test_rounding_generated(spark, values):
    got = evaluate(spark, values, N.half_even, "double")
    assert got == list(pd.Series(values).round(2))


def test_ratings(spark):
    odd = ["5", " 5 ", "2.0", "n/a", "", "NaN", "nan", "5d", "5.", ".5", "+5", "1e2", "1e", "0x10", "1,000", "inf",
           "-Infinity", "1e400", "5 ", None]
    want = [None if pd.isna(v) else v for v in pd.to_numeric(pd.Series(odd), errors="coerce")]
    assert evaluate(spark, odd, N.coerce_rating) == want


def test_dates(spark):
    days = ["2024-01-02", "2024/1/2", "1/2/2024", "January 2, 2024", "Jan 2, 2024", "2 January 2024", "bad", "2024/13/40", "", None]
    got = evaluate(spark, days, N.coerce_date)
    assert [v and v.strftime("%Y-%m-%d") for v in got] == ["2024-01-02"] * 6 + [None] * 4


@pytest.mark.parametrize(
    "value, want",
    [("5 stars", "5星"), ("1 stars", "1星s"), ("a  b\n c", "a b c"), (None, None)],
)
def test_normalise(spark, value, want):
    assert evaluate(spark, [value], X.normalise_text) == [want]


def test_five_marks_become_three(spark):
    assert evaluate(spark, ["。。。。。"], X.clean_output) == ["。。。"]


def test_chunks(spark):
    text = "aaaa bbbb. cc. " + "d" * 36 + ". ee."
    assert evaluate(spark, [text, None], lambda c: X.chunk_text(c, 20)) == [
        ["aaaa bbbb. cc.", "d" * 36 + ".", "ee.."],
        None,
    ]


def test_words(spark):
    assert evaluate(spark, ["Café  don't foo_bar taste", None], X.tokenise) == [["don", "t", "taste"], []]


def test_cache_key(spark):
    got = evaluate(spark, ["a"], lambda c: X.cache_key(c, F.lit("google"), F.lit("en"), F.lit("zh")))
    assert got == ["84120746bff9399dd1b516a4a42b0c93"] == [hashlib.md5(b"a_google_en_zh").hexdigest()]


def test_half_even(spark):
    assert evaluate(spark, [0.125, 12.345, 1.015], N.half_even, "double") == [0.12, 12.34, 1.01]


def test_error_class_takes_first_code(spark):
    messages = ["401 then 404", "401", "429", "Read TIMEOUT", "boom", None]
    assert evaluate(spark, messages, X.error_class) == [
        "not_found", "unauthorized", "rate_limited", "timeout", "other", None,
    ]


def test_prompt(spark):
    def render(prompt):
        return evaluate(spark, ["T{x}"], lambda c: X.render_prompt(F.lit(prompt), c))[0]

    assert render("say {Content} {odd}") == "say T{x} {odd}"
    assert render("say {text}") == "say T{x}"
    assert render("plain") == "plain"
    assert render("{Content} {text}") == "T{x} {text}"


def test_group_key_needs_every_part(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(X.group_key(F.col("x"), F.col("y"))).collect()] == ["a - b", None]

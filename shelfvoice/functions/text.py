"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfvoice.schema import CHUNK_CHARS, GROUP_SEPARATOR

# Every character Unicode counts as white space, from the rule itself.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
WHITESPACE_CLASS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"

# --- Fixed values: replacement rules that decide results ------------------
STAR_TERMS = [
    ("5 stars", "5星"),
    ("4 stars", "4星"),
    ("3 stars", "3星"),
    ("2 stars", "2星"),
    ("1 star", "1星"),
]
DOUBLED_MARKS = [("。。", "。"), ("，，", "，"), ("！！", "！"), ("？？", "？")]
SENTENCE_END = ". "
CONTENT_SLOT = "{Content}"
TEXT_SLOT = "{text}"
# In this order: a message with several codes takes the first class.
ERROR_CLASSES = [
    ("404", "not_found"),
    ("401", "unauthorized"),
    ("429", "rate_limited"),
    ("timeout", "timeout"),
]
# ---------------------------------------------------------------------------

_WORD_CHARACTER = r"[\p{L}\p{N}_]"


def trim_text(c: Column) -> Column:
    """Strip Unicode white space at both ends; NULL stays NULL.

    Most texts have none, which a look at both end characters settles.
    """
    space = F.lit(WHITESPACE)
    at_an_end = F.contains(space, F.left(c, F.lit(1))) | F.contains(space, F.right(c, F.lit(1)))
    return F.when(at_an_end, F.btrim(c, space)).otherwise(c)


def blank_to_null(c: Column) -> Column:
    """Trimmed text, with an empty result as NULL."""
    return F.nullif(trim_text(c), F.lit(""))


def nonblank(c: Column) -> Column:
    return F.coalesce(trim_text(c) != "", F.lit(False))


def group_key(*parts: Column) -> Column:
    """Composite key ``A - B``; NULL when any part is missing."""
    pieces = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit(GROUP_SEPARATOR), part]
    return F.concat(*pieces)


def plain_words(c: Column, min_length: int = 1) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, in order.

    A run that touches another letter, digit or underscore (``café``,
    ``foo_bar``) is no word, nor is any part of it.
    """
    run = rf"(?<!{_WORD_CHARACTER})[a-z0-9]{{{min_length},}}+(?!{_WORD_CHARACTER})"
    return F.regexp_extract_all(F.lower(c), F.lit(run), F.lit(0))


def tokenise(c: Column) -> Column:
    """Words of a text; missing text has none."""
    return F.coalesce(plain_words(c), F.array().cast("array<string>"))


def contains_ci(lower_text: Column, keyword: str) -> Column:
    """Literal substring test; the text is lower case already."""
    return F.contains(lower_text, F.lower(F.lit(keyword)))


def normalise_text(c: Column) -> Column:
    """Collapse white space and shorten star phrases."""
    out = F.btrim(F.regexp_replace(c, WHITESPACE_CLASS + "+", " "))
    for phrase, short in STAR_TERMS:
        out = F.replace(out, F.lit(phrase), F.lit(short))
    return out


def clean_output(c: Column) -> Column:
    """Collapse doubled full-width marks, one pass per mark."""
    out = c
    for doubled, single in DOUBLED_MARKS:
        out = F.replace(out, F.lit(doubled), F.lit(single))
    return out


def chunk_text(c: Column, limit: int = CHUNK_CHARS) -> Column:
    """Pack whole sentences greedily into pieces below ``limit`` characters.

    Text within the limit is one piece. A longer sentence stays whole, and each
    sentence of a split text ends in a full stop, the last one included.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("open"),
    )

    def step(acc: Column, sentence: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(sentence) < limit
        with_stop = F.concat(sentence, F.lit(SENTENCE_END))
        return F.struct(
            F.when(fits | (acc["open"] == ""), acc["done"])
            .otherwise(F.concat(acc["done"], F.array(trim_text(acc["open"]))))
            .alias("done"),
            F.when(fits, F.concat(acc["open"], with_stop)).otherwise(with_stop).alias("open"),
        )

    packed = F.aggregate(
        F.split(c, "[.] "),
        start,
        step,
        lambda acc: F.concat(acc["done"], F.array(trim_text(acc["open"]))),
    )
    return F.when(F.length(c) > limit, packed).when(c.isNotNull(), F.array(c))


def render_prompt(prompt: Column, text: Column) -> Column:
    """Put the text into the prompt's slot; a prompt without one is unchanged."""
    return (
        F.when(F.contains(prompt, F.lit(CONTENT_SLOT)), F.replace(prompt, F.lit(CONTENT_SLOT), text))
        .when(F.contains(prompt, F.lit(TEXT_SLOT)), F.replace(prompt, F.lit(TEXT_SLOT), text))
        .otherwise(prompt)
    )


def cache_key(*parts: Column) -> Column:
    """md5 of the parts joined with ``_``; no part may be NULL."""
    return F.md5(F.concat_ws("_", *parts))


def preview_text(c: Column, n: int) -> Column:
    """First ``n`` characters, with dots when there is more."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def error_class(message: Column) -> Column:
    """Class of a failure message; NULL when there was no failure."""
    low = F.lower(message)
    out = F.when(message.isNull(), F.lit(None).cast("string"))
    for mark, name in ERROR_CLASSES:
        out = out.when(F.contains(low, F.lit(mark)), F.lit(name))
    return out.otherwise("other")

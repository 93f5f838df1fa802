"""Sinks for processed, tagged and enriched tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated text with a header; missing values are empty.

    Values with tabs, quotes or line breaks are quoted, so that each row can be
    read back whole.
    """
    df.write.mode(mode).options(
        sep="\t",
        header=True,
        nullValue="",
        emptyValue="",
        escape='"',
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Result table as Parquet (default), JSON lines or CSV."""
    if fmt == "csv":
        df.write.mode(mode).csv(
            path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    elif fmt in ("parquet", "json"):
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_lexicon_json(lexicon: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lexicon as nested documents ``{main: {sub: "kw,kw"}}``, a line for each main category, as the reader takes them."""
    subs = lexicon.groupBy("main", "sub").agg(F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("keywords"))
    mains = subs.groupBy("main").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sub", "keywords")))).alias("subs"))
    mains.select(F.to_json(F.create_map("main", "subs")).alias("value")).write.mode(mode).text(path)


def write_words_json(words: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Word list as documents of one word a line, so that a long list is written by many tasks."""
    words.select(F.to_json(F.array("word")).alias("value")).write.mode(mode).text(path)


def export_projection(df: DataFrame, sources: list[str], generated: list[str], keep_sources: bool = True) -> DataFrame:
    """Export columns: everything, or without the source texts and with the generated columns last."""
    if keep_sources:
        return df
    others = [c for c in df.columns if c not in sources and c not in generated]
    return df.select(*others, *generated)


def text_columns(df: DataFrame, excluded: list[str]) -> list[str]:
    """Names of the string columns outside ``excluded``; metadata only."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in excluded]

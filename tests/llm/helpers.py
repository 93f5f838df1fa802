"""Tables that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

LONG = " ".join(f"word{k % 977} x{k}" for k in range(20_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again until night falls on the hill", "en", "src/a", 0),
    (2, "The quick brown fox jumps over the lazy dog again and again until night falls on the hill", "en", "src/a", 0),
    (3, None, "en", None, 0),
    (4, "", None, "src/b", 0),
    (5, LONG, "en", "src/b", 1),
    (6, " \t\n ", "en", "src/c", 2),
    (7, "one", "de", "src/c", 2),
    (7, "one", "de", "src/c", 2),
    (None, "a row without an id", "en", "src/d", 3),
    (8, "don't 'say' <|endoftext|> é中😀 \x00 end", "en", "src/d", None),
]
#: ``piece``, ``fp`` and ``trie`` are also names inside operators.
SCHEMA = "doc_id long, text string, lang string, source string, piece int"


def table(spark, rows=ROWS):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit("clash"), "start": F.lit(None).cast("int"), "bucket": F.lit(1.5), "score": F.lit("s")})


def empty(spark):
    return table(spark).filter("doc_id = -99")

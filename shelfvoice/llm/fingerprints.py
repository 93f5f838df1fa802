"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction of all hashes.

Two sketches made with one threshold are samples of their texts' shingles by the
same rule, so they merge by union and estimate containment also between a short
and a very long text. Texts with few shingles would keep too few hashes, so each
sketch also keeps its smallest ones; it is then complete up to its largest hash,
and two sketches are compared up to the smaller of their bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, partitions, range_buckets

SHINGLE = 5
#: Hashes are 63 bits; kept are those below this fraction, and the least ``FLOOR`` in any case.
FRACTION = 1 / 4
FLOOR = 32
_TOP = (1 << 63) - 1


def sketch(text: Column, fraction: float = FRACTION, floor: int = FLOOR, shingle: int = SHINGLE) -> Column:
    """Ascending array of the kept hashes of five-word shingles (fewer words: all of them as one; none: empty).

    Words are cut at white space, in lower case; repeated shingles count once.
    """
    bound = int(_TOP * fraction)
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: F.length(w) > 0)
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(shingle))))
        one = F.array(F.xxhash64(h))
        return F.when(n >= shingle, each).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    def kept(h: Column) -> Column:
        low = F.array_distinct(F.filter(h, lambda x: x < bound))
        return F.when(F.size(low) >= floor, F.array_sort(low)).otherwise(F.slice(F.array_sort(F.array_distinct(h)), 1, floor))

    made = F.transform(F.array(hashed), shingles)
    positive = F.transform(made, lambda h: F.transform(h, lambda x: x.bitwiseAND(F.lit(_TOP))))
    return F.transform(positive, kept)[0]


def reach(a: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """Up to which hash a sketch is complete."""
    bound = int(_TOP * fraction)
    return F.when(F.size(a) < floor, F.lit(_TOP)).otherwise(F.greatest(F.element_at(a, -1), F.lit(bound)))


def merge(a: Column, b: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """Sketch of both texts' shingles together."""
    bound = int(_TOP * fraction)
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: x < bound)
    return F.when(F.size(low) >= floor, low).otherwise(F.slice(both, 1, floor))


def _compared(a: Column, b: Column, fraction: float, floor: int, ratio) -> Column:
    held = F.array(F.struct(a.alias("a"), b.alias("b"), F.least(reach(a, fraction, floor), reach(b, fraction, floor)).alias("to")))
    cut = F.transform(held, lambda s: F.struct(F.filter(s["a"], lambda x: x <= s["to"]).alias("a"), F.filter(s["b"], lambda x: x <= s["to"]).alias("b")))
    return F.transform(cut, lambda s: ratio(s["a"], s["b"]))[0]


def likeness(a: Column, b: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike, an empty one and another are not."""

    def ratio(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x, y))
        all_ = F.size(x) + F.size(y) - shared
        return F.when(all_ == 0, F.lit(1.0)).otherwise(shared / all_)

    return F.when(a == b, F.lit(1.0)).otherwise(_compared(a, b, fraction, floor, ratio))


def containment(a: Column, b: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """Estimated share of a's shingles that b has; NULL if nothing of a can be compared."""

    def ratio(x: Column, y: Column) -> Column:
        return F.when(F.size(x) == 0, F.lit(None).cast("double")).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))

    return _compared(a, b, fraction, floor, ratio)


def printed(a: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, ascending."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.hex(x)), "."))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sketch)`` for each row; mergeable with :func:`merge`."""
    return docs.select(col(id_col).cast("long").alias("doc_id"), sketch(col(text_col).cast("string")).alias("sketch"))


def _place(key: Column, bounds: list[int]) -> Column:
    """How many ascending bounds are at most the key; looked up in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda values: F.aggregate(values, F.lit(0), lambda n, b: n + (key >= b).cast("int"))
    if not bounds:
        return F.lit(0)
    block = below(F.array(*(F.lit(b).cast("long") for b in bounds[step - 1 :: step])))
    return block * step + below(F.slice(F.array(*(F.lit(b).cast("long") for b in bounds)), block * step + 1, F.lit(step)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, next_text, bucket, ghost)``: each row with the text after it, by ascending id, the last one with the first.

    Rows are dealt by ranges of the id. The rows of a range's least id are also
    sent to the range before it, as ghosts after all its rows, so each range
    finds its successors at home and texts move once. Ghosts are still in the
    result. Rows that share an id follow each other by their text; null ids come
    first.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = range_buckets(rows, "doc_id", 4 * partitions(rows.sparkSession))
    dealt = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_place(F.col("doc_id"), bounds)))
    # One row for each range, of which there are a fixed number: the least id in it.
    least = sorted((r[0], r[1], r[2]) for r in dealt.groupBy("bucket").agg(F.min("doc_id"), F.bool_or(F.col("doc_id").isNull())).collect())
    known = {own: (low, least[k - 1][0]) for k, (own, low, _) in enumerate(least)}
    nulls = bool(least and least[0][2])
    at = F.col("bucket") + 1
    low = F.element_at(F.array(*(F.lit(known.get(k, (None,))[0]).cast("long") for k in range(len(bounds) + 1))), at)
    before = F.element_at(F.array(*(F.lit(known.get(k, (0, None))[1]).cast("int") for k in range(len(bounds) + 1))), at)
    leads = F.col("doc_id").isNull() | (F.col("doc_id") == low) & ~(F.lit(nulls) & (F.col("bucket") == 0))
    first = F.when(leads, before)
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")), F.struct(first.alias("bucket"), F.lit(True).alias("ghost")))
    spread = dealt.withColumn("place", F.explode(F.filter(places, lambda p: p["bucket"].isNotNull()))).select("doc_id", "text", "place.bucket", "place.ghost")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    return spread.withColumn("next_text", F.lead("text").over(order))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by
    the first as many (or all) of the next row's text. Null texts count as
    empty. A lone row is its own successor. Repeated rows give a row each; an
    empty table gives an empty one; other columns are not read.
    """
    paired = with_next(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    made = paired.withColumn("edited", edited).withColumns({"own": sketch(F.col("text")), "changed": sketch(F.col("edited"))})
    made = made.withColumn("next", F.lead("own").over(order)).filter(~F.col("ghost"))
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )

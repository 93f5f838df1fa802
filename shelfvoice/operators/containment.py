"""Which texts hold which keywords, for lexicons of any size.

Each keyword has a gram: itself, or of a long one its rarest run of ``GRAM``
characters, counted over the lexicon. A Bloom filter of the grams goes to the
tasks, which look up every place of a text there, for one length after the other
and by rolling hashes in numpy. Only what the filter lets through leaves a task:
once a text, and near to what the text does hold. It is then joined to the grams
by equality, which decides; ``contains`` decides for the long keywords. Neither
the lexicon nor a text's grams are ever collected, and texts shuffle for long
keywords only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfvoice.functions.numbers import percent
from shelfvoice.operators.joins import fits_broadcast, salted_inner
from shelfvoice.sources.workspace import stage

#: Characters of a gram; a shorter keyword is its own gram.
GRAM = 24
#: Bytes of texts that are looked up at a time.
STRETCH = 1 << 16
#: Bits of the filter as a power of two: at least and at most, and how many more than the grams need.
BLOOM_BITS, SPARE_BITS = (15, 28), 6


def _grams(text: Column, length: int) -> Column:
    """All runs of ``length`` characters; none of a shorter text. One pass: a substring would count from the start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def gram_keys(keywords: DataFrame, gram: int = GRAM) -> DataFrame:
    """``(gram, low, keyword)``: each distinct keyword that is not blank, with its gram that the fewest keywords have."""
    known = keywords.select("keyword").filter(F.trim("keyword") != "").distinct().withColumn("low", F.lower("keyword"))
    grams = F.when(F.length("low") < gram, F.array("low")).otherwise(_grams(F.col("low"), gram))
    each = known.select("low").distinct().select("low", F.explode(F.array_distinct(grams)).alias("gram"))
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(shared, "gram").groupBy("low").agg(F.min(F.struct("n", "gram")).alias("best"))
    return known.join(rarest, "low").select(F.col("best.gram").alias("gram"), "low", "keyword")


def _scanner(lengths: list[int], bits: int, stretch: int):
    """``(placed, found)``, both over batches of ``(id, binary)``: the filter's bits for whole values, and the runs of these lengths that the filter holds.

    Nested, so that workers get it by value. A run's hash is a difference of
    running sums, times the inverse of its place's power; all is modulo 2^64.
    Lengths from one power of two to the next share a look-up: the filter also
    has how each value begins, as far as the least of those lengths, and only
    places that pass are looked up for each length.
    """
    import numpy as np
    import pyarrow as pa

    u64 = np.uint64
    factor, inverse = (u64(x) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
    mixes, shift = [u64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)], u64(64 - bits)
    classes: dict[int, list[int]] = {}
    for n in sorted(lengths):
        classes.setdefault(n.bit_length(), []).append(n)
    begin = np.array([classes[n.bit_length()][0] if n.bit_length() in classes else n for n in range(max(lengths) + 1)])
    spread = np.random.default_rng(42).integers(1, 1 << 64, 256, u64, endpoint=False)

    def powers(base: u64, n: int) -> np.ndarray:
        out = np.full(n + 1, base, u64)
        out[0] = 1
        return np.cumprod(out, dtype=u64)

    def sums(data: np.ndarray, ups: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, u64)
        np.cumsum(spread[data] * ups[: len(data)], out=out[1:], dtype=u64)
        return out

    def parts(batch):
        """``(first row, ends, bytes)`` of runs of rows that hold about ``stretch`` bytes, or of one longer row."""
        column = batch.column(1).cast(pa.large_binary())
        if not len(column):
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(column):
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + stretch, "right")) - 1)
            yield row, offsets[row : to + 1] - offsets[row], data[offsets[row] : offsets[to]]
            row = to

    def placed(batches):
        for batch in batches:
            for _, ends, data in parts(batch):
                ups, downs = powers(factor, len(data)), powers(inverse, len(data))
                run = sums(data, ups)
                starts = ends[:-1]
                for to in (ends[1:], starts + begin[ends[1:] - starts]):
                    hashed = (run[to] - run[starts]) * downs[starts]
                    for mix in mixes:
                        yield pa.RecordBatch.from_arrays([pa.array((hashed * mix >> shift).astype(np.int64))], ["bit"])

    def found(held):
        longest = max(lengths)

        def has(at: np.ndarray, table: np.ndarray) -> np.ndarray:
            return (table[at >> u64(3)] >> (at & u64(7)).astype(np.uint8)) & 1

        def passed(run: np.ndarray, downs: np.ndarray, at: np.ndarray, n: int, table: np.ndarray, untried: list) -> np.ndarray:
            """Those of the places where the filter holds a run of ``n`` bytes."""
            at = at[at + n < len(run)]
            hashed = (run[at + n] - run[at]) * downs[at]
            for mix in untried:
                held = np.flatnonzero(has(hashed * mix >> shift, table))
                at, hashed = at[held], hashed[held]
            return at

        def runs(piece: np.ndarray, n: int, at: np.ndarray, start: int, first: int, ends: np.ndarray) -> pa.Table:
            """``(row, gram)`` of the runs at these places that lie in one row."""
            row = np.searchsorted(ends, at + start, "right") - 1
            inside = at + start + n <= ends[row + 1]
            at, row = at[inside], row[inside]
            made = np.lib.stride_tricks.sliding_window_view(piece, n)[at]
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(at), [None, pa.py_buffer(made.tobytes())])
            return pa.table([pa.array(row + first), flat.cast(pa.binary())], ["row", "gram"])

        def search(batches):
            table = np.frombuffer(held.value, np.uint8)
            ups, downs = powers(factor, stretch + longest), powers(inverse, stretch + longest)
            firsts = downs * mixes[0]
            for batch in batches:
                for first, ends, data in parts(batch):
                    hits = []
                    for start in range(0, len(data), stretch):
                        # Runs that begin in these bytes; they may end behind them.
                        piece = data[start : start + stretch + longest - 1]
                        run = sums(piece, ups)
                        for least, *others in classes.values():
                            size = min(stretch, len(piece) - least + 1)
                            if size <= 0:
                                continue
                            hashed = run[least : least + size] - run[:size]
                            at = np.flatnonzero(has(hashed * firsts[:size] >> shift, table))
                            begun = passed(run, downs, at, least, table, mixes[1:])
                            each = [(least, begun), *((n, passed(run, downs, begun, n, table, mixes)) for n in others)]
                            hits += [runs(piece, n, at, start, first, ends) for n, at in each if len(at)]
                        if start:
                            hits = [pa.concat_tables(hits).group_by(["row", "gram"]).aggregate([])] if hits else []
                    if not hits:
                        continue
                    once = pa.concat_tables(hits).group_by(["row", "gram"]).aggregate([]).combine_chunks()
                    for made in pa.table([batch.column(0).take(once["row"].combine_chunks()), once["gram"]], ["id", "gram"]).to_batches(100_000):
                        yield made

        return search

    return placed, found


def text_grams(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``(id, gram)`` of ``(id, low)``: what a text has of the grams of ``keys``, once for each row, and very little else."""
    spark = texts.sparkSession
    grams = keys.select(F.lit(0).alias("id"), F.col("gram").cast("binary").alias("gram")).distinct()
    # As many numbers as a gram has bytes at most, and as many rows as the filter has blocks of 4 KB.
    sizes = grams.groupBy(F.octet_length("gram").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
    kind = texts.schema["id"].dataType.simpleString()
    if not sizes:
        return spark.createDataFrame([], f"id {kind}, gram binary")
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], sum(r.rows for r in sizes).bit_length() + SPARE_BITS))
    placed, found = _scanner(sorted(r.n for r in sizes), bits, STRETCH)
    filled = bytearray(1 << (bits - 3))
    blocks = grams.mapInArrow(placed, "bit long").groupBy(F.shiftright("bit", 15).alias("block"))
    for row in blocks.agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767).cast("long"))).alias("bits")).toLocalIterator():
        filled[row.block * 4096 : row.block * 4096 + len(row.bits)] = row.bits
    held = spark.sparkContext.broadcast(bytes(filled))
    return texts.select("id", F.col("low").cast("binary").alias("low")).mapInArrow(found(held), f"id {kind}, gram binary")


def _texts(df: DataFrame, column: str, id_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{column}`")).alias("low")).filter("low IS NOT NULL")


def _is_long() -> Column:
    """Whether a gram is only a part of its keyword."""
    return F.col("gram") != F.col("low")


def _meet(grams: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of both with the same gram. Keys go by broadcast if measured small; else a gram that very many texts have is split over salts."""
    keys = keys.withColumn("gram", F.col("gram").cast("binary"))
    if fits_broadcast(keys):
        return grams.join(F.broadcast(keys), "gram")
    return salted_inner(stage(grams, "text-grams"), keys, "gram", F.col("id"))


def _held(texts: DataFrame, keys: DataFrame, *carried: str) -> DataFrame:
    """``(id, *carried)`` for each text and row of ``keys`` whose keyword it holds."""
    met = _meet(text_grams(texts, keys), keys)
    if keys.filter(_is_long()).isEmpty():
        return met.select("id", *carried)
    met = stage(met.select("id", F.col("low").alias("sought"), F.length("gram").alias("n"), *carried), "met")
    sure, seen = F.octet_length("sought") == F.col("n"), met.filter(F.octet_length("sought") > F.col("n")).distinct()
    same = seen["id"].eqNullSafe(texts["id"]) & F.contains(texts["low"], seen["sought"])
    checked = seen.join(texts, same).select(seen["id"], *carried)
    return met.filter(sure).select("id", *carried).unionByName(checked)


def held_keywords(df: DataFrame, keywords: DataFrame, column: str = "Content", id_col: str = "ID", gram: int = GRAM) -> DataFrame:
    """``(id, keyword)``, once for each text and distinct keyword that it holds anywhere, whatever the case.

    ``id_col`` must identify a row. Missing texts hold nothing, blank keywords
    are in no text.
    """
    return _held(_texts(df, column, id_col), stage(gram_keys(keywords, gram), "gram-keys"), "keyword")


def _category_keys(lexicon: DataFrame) -> DataFrame:
    """``gram_keys`` with the categories of each keyword."""
    entries = lexicon.select("main", "sub", "keyword").distinct()
    return stage(gram_keys(entries).join(entries, "keyword").select("gram", "low", "main", "sub", "keyword"), "gram-keys")


def lexicon_pairs(df: DataFrame, lexicon: DataFrame, column: str = "Content", id_col: str = "ID") -> DataFrame:
    """``(id, main, sub, keyword)``: one row for each text, category and keyword held."""
    held = _held(_texts(df, column, id_col), _category_keys(lexicon), "main", "sub", "keyword")
    return held.withColumnRenamed("id", id_col)


def keyword_frequency(df: DataFrame, lexicon: DataFrame, column: str = "Content", id_col: str = "ID") -> DataFrame:
    """``(main, sub, keyword, n)``: texts that hold each keyword; keywords in none are absent.

    A gram's texts are counted before it meets the keywords that it is; only long keywords are paired with texts.
    """
    texts, keys = _texts(df, column, id_col), _category_keys(lexicon)
    short, long = keys.filter(~_is_long()), keys.filter(_is_long())
    counts = text_grams(texts, short).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(short.withColumn("gram", F.col("gram").cast("binary")), "gram").select("main", "sub", "keyword", "n")
    if long.isEmpty():
        return found
    paired = _held(texts, long, "main", "sub", "keyword").groupBy("main", "sub", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(paired)


def category_stats(df: DataFrame, lexicon: DataFrame, column: str = "Content", id_col: str = "ID") -> DataFrame:
    """``(main, sub, matched, pct, unmatched)`` of every category of the lexicon, also of those in no text."""
    keys = _category_keys(lexicon)
    found = _held(_texts(df, column, id_col).filter("id IS NOT NULL"), keys.select("gram", "low", "main", "sub").distinct(), "main", "sub")
    matched = found.distinct().groupBy("main", "sub").agg(F.count(F.lit(1)).alias("matched"))
    # One row with the number of texts.
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    rows = lexicon.select("main", "sub").distinct().join(matched, ["main", "sub"], "left").fillna(0, ["matched"])
    rows = rows.withColumn("_n", total.scalar())
    return rows.select("main", "sub", "matched", percent(F.col("matched"), F.col("_n")).alias("pct"), (F.col("_n") - F.col("matched")).alias("unmatched"))

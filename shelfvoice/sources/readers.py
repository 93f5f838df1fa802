"""Scans of review tables, brand tables and cache files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvoice.schema import BRAND_REQUIRED, PARENT_ASIN, REQUIRED, require_columns

FILE_COLUMN = "_file"
SPLIT_COLUMN = "_split"
ROW_COLUMN = "_row"
POSITION_COLUMNS = [FILE_COLUMN, SPLIT_COLUMN, ROW_COLUMN]


def _scan(spark: SparkSession, path: str, fmt: str, multi_line: bool = True) -> DataFrame:
    """Text formats are read as text only: types are coerced later, never guessed."""
    if fmt == "csv":
        return spark.read.csv(path, header=True, multiLine=multi_line, escape='"', inferSchema=False)
    if fmt == "json":
        return spark.read.json(path, primitivesAsString=True)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def with_position(df: DataFrame, fmt: str) -> DataFrame:
    """Add where each row of a file scan stands in the input.

    Parquet knows a row's index in its file. In text formats a row's place is its
    running id among the rows of its task, which reads its splits one by one;
    the same files are always packed into the same tasks.
    """
    row = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
    split = F.lit(0).cast("long") if fmt == "parquet" else F.col("_metadata.file_block_start")
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE_COLUMN),
        split.alias(SPLIT_COLUMN),
        row.alias(ROW_COLUMN),
    )


def literal_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Hand-kept text rows (a word list, a lexicon) as a table.

    Arrow input becomes a local relation: Catalyst knows its size and no Python
    task reads it.
    """
    arrays = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))]
    return spark.createDataFrame(pa.table(dict(zip(columns, arrays))))


SMALL_TABLE_SPLITS = 64


def spread_small(df: DataFrame) -> DataFrame:
    """Deal a small table out over the cores before work that is heavy per row.

    A file with one row group is one task however many cores there are. A table
    with more splits passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(cores, SMALL_TABLE_SPLITS):
        return df
    return df.repartition(cores)


def read_reviews(spark: SparkSession, path: str, fmt: str = "csv", position: bool = True, multi_line: bool = True) -> DataFrame:
    """Raw review table: checked for its columns, cut down to them.

    With ``position`` the input position comes along as ``_file, _split, _row``.
    Fields of a CSV file may span lines, so a file is one split; where they do
    not, ``multi_line=False`` lets large files be read by many tasks.
    """
    df = _scan(spark, path, fmt, multi_line)
    require_columns(df, REQUIRED)
    if not position:
        return df.select(*REQUIRED)
    return with_position(df, fmt).select(*REQUIRED, *POSITION_COLUMNS)


def read_brands(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Brand table with its input position; the parent key is optional."""
    df = _scan(spark, path, fmt)
    require_columns(df, BRAND_REQUIRED)
    keep = BRAND_REQUIRED + ([PARENT_ASIN] if has_parent(df) else [])
    return with_position(df, fmt).select(*keep, *POSITION_COLUMNS)


def has_parent(brands: DataFrame) -> bool:
    return PARENT_ASIN in brands.columns


def read_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested lexicon documents ``{main: {sub: "kw,kw"}}``, one a file or a line, as ``(main, sub, keywords)``.

    A flat file ``{name: "kw,kw"}`` gives rows with ``main`` NULL, which
    ``lexicon.upgrade_flat`` places.
    """
    lines = spark.read.text(path, wholetext=True).select(F.explode(_documents(F.col("value"))).alias("doc"))
    text = lines.filter(F.trim("doc") != "")
    top = text.select(
        F.explode(F.from_json("doc", T.MapType(T.StringType(), T.StringType()))).alias("name", "body")
    )
    nested = F.from_json("body", T.MapType(T.StringType(), T.StringType()))
    is_nested = F.ltrim("body").startswith("{")
    deep = top.filter(is_nested).select(
        F.col("name").alias("main"), F.explode(nested).alias("sub", "keywords")
    )
    flat = top.filter(~is_nested).select(
        F.lit(None).cast("string").alias("main"), F.col("name").alias("sub"), F.col("body").alias("keywords")
    )
    return deep.unionByName(flat)


def read_words_json(spark: SparkSession, path: str) -> DataFrame:
    """Word list documents ``["a", "b"]``, one a file or a line, as ``(word)``."""
    text = spark.read.text(path, wholetext=True).select(F.explode(_documents(F.col("value"))).alias("doc"))
    return text.select(F.explode(F.from_json("doc", T.ArrayType(T.StringType()))).alias("word"))


def _documents(file: Column) -> Column:
    """The lines of a file if each is a JSON document, else the file as one."""
    lines = F.filter(F.split(file, "\n"), lambda x: F.trim(x) != "")
    whole = F.forall(lines, lambda x: F.json_object_keys(x).isNotNull() | F.json_array_length(x).isNotNull())
    return F.when(whole, lines).otherwise(F.array(file))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with size and time; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("n_bytes"))
    )

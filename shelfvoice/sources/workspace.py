"""Shared folder for staged tables.

A staged table cuts lineage: it survives the loss of an executor, and what was
computed once (external calls, row positions) is never computed again with a
different outcome. Parquet is used rather than an RDD checkpoint so that later
reads prune columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_root: str | None = None
_staged: list[str] = []


def work_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets a new folder."""
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all executors can reach")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="shelfvoice-")
    return _local_root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the work folder and return it read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_rounds(frames: Iterable[DataFrame], name: str, after: Callable[[DataFrame], None] = lambda _: None) -> DataFrame:
    """Write frames of one schema in turn and return all rows read back.

    Each frame is whole in the work folder, and ``after`` was called with it,
    before the next one is asked for. At least one frame is needed.
    """
    path = None
    for i, df in enumerate(frames):
        spark, schema = df.sparkSession, df.schema
        if path is None:
            path = new_path(spark, name)
            _staged.append(path)
        df.write.parquet(f"{path}/round={i}")
        after(spark.read.schema(schema).parquet(f"{path}/round={i}"))
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def cleanup(spark: SparkSession) -> int:
    """Remove the tables staged so far; call it when the results that rest on them are written. Returns their number.

    Works on any file system that Spark reaches, through an empty overwrite.
    """
    n = 0
    while _staged:
        spark.createDataFrame([], "nothing int").coalesce(1).write.mode("overwrite").parquet(_staged.pop())
        n += 1
    return n

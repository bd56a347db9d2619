"""Cutting lineage where a result is used more than once, and the size checks of broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that all executors share. In local mode, where there is one machine, a temporary one if that is unset."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "local")
    if folder is None and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or _local_folder()


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames that are made and run meanwhile go as soon as their result is written, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, so that later uses neither compute them again nor depend on an executor. Their shuffle files go at once."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with short_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def _size(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes as JSON, of a written frame."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return size["n"], size["b"]


def met_in_blocks(asked: DataFrame, rows: DataFrame, block: int = 2000, bucket: int = 50_000, block_bytes: int = 32 << 20) -> DataFrame:
    """Every one of a stated query set beside every row. Up to `block` queries of up to `block_bytes` are broadcast; more are met in a grid of blocks of queries and buckets of rows, each cell a key of its own."""
    asked = written(asked)
    n, size = _size(asked)
    if n <= block and size <= block_bytes:
        return rows.join(F.broadcast(asked), F.lit(True))
    blocks, buckets = max(-(-n // block), -(-size // block_bytes)), -(-rows.count() // bucket)
    cell = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(max(k, 1) - 1)))
    left = rows.withColumn("_bucket", cell(rows, max(buckets, 1))).withColumn("_block", every(blocks))
    return left.join(asked.withColumn("_block", cell(asked, blocks)).withColumn("_bucket", every(buckets)), ["_block", "_bucket"]).drop("_block", "_bucket")


def met_by_key(asked: DataFrame, rows: DataFrame, key: str | list[str], block: int = 2000, bucket: int = 50_000, block_bytes: int = 32 << 20) -> DataFrame:
    """Every one of a stated query set beside every row of its key, of which there may be few: a small set is broadcast, so rows stay where they are; of a larger one each query is dealt to buckets of its
    key's rows, so no task gets all rows of a key."""
    asked = written(asked)
    n, size = _size(asked)
    if n <= block and size <= block_bytes:
        return rows.join(F.broadcast(asked), key)
    buckets = max(1, -(-rows.count() // bucket))
    left = rows.withColumn("_bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(buckets)).cast("int"))
    return left.join(asked.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))), [*([key] if isinstance(key, str) else key), "_bucket"]).drop("_bucket")


def if_small(df: DataFrame, most_rows: int = 500_000, most_bytes: int = 64 << 20) -> DataFrame:
    """A broadcast hint if the (written) frame has at most so many rows and, as JSON, bytes; else the frame as it is, for a shuffle join that Spark may split."""
    n, size = _size(df)
    return F.broadcast(df) if n <= most_rows and size <= most_bytes else df

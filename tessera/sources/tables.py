"""Views that give the test tables the roles of a retrieval platform's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import shared_folder
from tessera.sources import lexical, vectors
from tessera.sources.sinks import IncompleteGeneration


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that comes in fewer partitions than there are cores (in one row group, say) is dealt out to all of them, as its rows are much work each."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and rows.rdd.getNumPartitions() < cores else rows


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, ts, user_id, tenant, status, duration_ms: one trace run for each event."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        "ts",
        "user_id",
        (F.col("user_id") % 5).alias("tenant"),
        F.when(kind == "error", "FAILED").when(kind == "view", "RUNNING").otherwise("SUCCESS").alias("status"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"),
    )


RUNS_SQL = """runs AS (SELECT event_id AS run_id, ts, user_id, user_id % 5 AS tenant,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
  CAST(round(value * 100) AS BIGINT) AS duration_ms FROM events)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, doc_id, kb, tenant, chunk_index, content: the lines of the documents, with knowledge base = source and tenant = lang."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.col("source").alias("kb"), F.col("lang").alias("tenant"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))
        .select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "kb", "tenant", "chunk_index", "content")
    )


CHUNKS_SQL = """chunks AS (SELECT doc_id || '-' || (i - 1) AS chunk_id, doc_id, source AS kb, lang AS tenant, CAST(i - 1 AS INTEGER) AS chunk_index, parts[i] AS content
  FROM (SELECT *, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"""


_OPENED: dict[tuple[str, str], object] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, kind: str, opened: Callable, built: Callable) -> object:
    """An index in the shared folder, built at first use and named after the paths, sizes and times of a table's files, so changed files get an index of their own."""
    files = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
    state = files.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s")).first()
    folder = f"{shared_folder(spark).rstrip('/')}/{kind}-{state['n']}-{(state['s'] or '0').replace('-', 'm')}"
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPENED:
        try:
            _OPENED[key] = opened(spark, folder)
        except IncompleteGeneration:
            _OPENED[key] = built(folder)
    return _OPENED[key]


def chunk_index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    """The stored lexical index of chunks()."""
    return _stored(spark, sf_dir, "documents", "lexical", lexical.opened, lambda folder: lexical.built(chunks(spark, sf_dir), folder))


def vector_index(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    """The stored index of all embeddings."""
    return _stored(spark, sf_dir, "embeddings", "vectors", vectors.opened, lambda folder: vectors.built(table(spark, sf_dir, "embeddings"), folder))

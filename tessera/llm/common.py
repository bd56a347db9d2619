"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the scans: runs of digits, lower-case letters and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


#: The same before A-Z are lowered, and what stands between such words.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The runs of ANY_WORD in a text; a null text has none. Cutting at what stands between them takes an eighth of the time of regexp_extract_all, which makes a matcher for each."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def word_hash(word: Column) -> Column:
    """XXH64 of a word found by ANY_WORD, A-Z lowered. ASCII words, by far the most, are lowered by the faster function."""
    return F.xxhash64(F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(lower_ascii(word)))


def word_positions(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """keep, _pos (from 0), _term (word_hash) of every word of every text."""
    words = docs.select(*keep, F.posexplode(words_of(text)).alias("_pos", "_word"))
    return words.select(*keep, "_pos", word_hash(F.col("_word")).alias("_term"))


def scan_words(text: Column) -> Column:
    """The words of a text for phrase scans; a null text has none."""
    return words_of(lower_ascii(text))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def indices(n: Column) -> Column:
    """0 .. n-1, empty for n < 1 (sequence alone would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns (128 bits) that tell rows apart: rows equal in them have equal id and text, so any result of a row is the same for them."""
    named = F.coalesce(doc_id.cast("string"), F.lit("no id"))
    return [F.xxhash64(named, text).alias("_k1"), F.xxhash64(text, F.lit("second"), named).alias("_k2")]


KEY = ["_k1", "_k2"]


def set_apart(docs: DataFrame, into: str) -> tuple[DataFrame, Column, Column, Callable[[DataFrame, Column], DataFrame]]:
    """docs under column names that clash with nothing, its doc_id (null if it has none), its text, and a function that gives a frame its old names back, with a value
    in the column `into` (in place of one of that name)."""
    names = {n: f"c{i}_" for i, n in enumerate(docs.columns)}

    def back(df: DataFrame, value: Column) -> DataFrame:
        return df.select(*[F.col(names[n]).alias(n) for n in docs.columns if n != into], value.alias(into))

    doc_id = F.col(names["doc_id"]) if "doc_id" in names else F.lit(None).cast("long")
    return docs.toDF(*names.values()), doc_id, F.col(names["text"]), back


def free_name(docs: DataFrame, wanted: str) -> str:
    """A column name that docs doesn't have."""
    while wanted in docs.columns:
        wanted += "_"
    return wanted


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode, where there is one machine, a temporary one if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folder()
    return folder.rstrip("/")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder; later reads outlive any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tabled(df: DataFrame) -> DataFrame:
    """The rows written once as a Parquet table to the shared folder: smaller than a checkpoint, for tables that grow with the corpus."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, most_rows: int = 500_000, most_bytes: int = 64 << 20) -> DataFrame:
    """A broadcast hint if the frame has at most so many rows and (as JSON) bytes, else the frame as it is: Spark then shuffles both sides.

    df should be stored: it is read for the count and again for the join."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= most_rows and size["b"] <= most_bytes else df


def fitted(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df in no more partitions than `rows` rows need, but in one for each core at least: a small table over all shuffle partitions costs a task and three files in each, in every
    step. Nothing is shuffled for it. What was partitioned by a key no longer counts as that, so a join that follows shuffles both sides and Spark can split it."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs meanwhile: Python workers then hold few texts, and what is made of them, at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with _setting(spark, name, str(min(rows, before) if before > 0 else rows)):
        yield


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go as soon as its result is written, not when the driver next collects its garbage. For jobs of many steps, each stored() or tabled()."""
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def tidied(results: Iterator) -> Iterator:
    """The results of a worker's batches; after each, memory that it no longer needs goes back to the system, as workers stay for later stages."""
    import ctypes

    import pyarrow as pa

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for result in results:
        yield result
        del result
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores: a table of fewer partitions than the cluster has cores (one row group, say) is dealt out before heavy work on its rows."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def bounded_sample(rows: DataFrame, by: str | None, most: int, *key: str) -> DataFrame:
    """At most `most` rows of each value of `by` (of all rows, if it is None), those with the smallest hashes of the key: a fixed sample, for fitting models only.

    The groups are counted first; a hash limit then lets about four times `most` rows of each through, however many there are, and only those are shuffled.
    """
    scale = 1 << 30
    if by is None:
        limit = 4.0 * most * scale / max(1, rows.count())
        few = rows.withColumn("_u", F.pmod(F.xxhash64(*key), F.lit(scale))).filter(F.col("_u") < limit)
        return few.orderBy("_u", *key).limit(most).drop("_u")
    counts = stored(rows.groupBy(by).agg(F.count("*").alias("_n")))
    hashed = rows.withColumn("_u", F.pmod(F.xxhash64(*key), F.lit(scale)))
    few = hashed.join(small_or_not(counts, 100_000), by).filter(F.col("_u").cast("double") * F.col("_n") < 4.0 * most * scale)
    first = Window.partitionBy(by).orderBy("_u", *key)
    return few.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= most).drop("_u", "_n", "_k")

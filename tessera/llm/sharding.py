"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, small_or_not, stored

#: numpy draws hypergeometric numbers only from populations below this.
_NUMPY_LIMIT = 10**9
MOST_BLOCKS = 1 << 16
#: Rows that are equal in id, size and checksum and may share a block.
MOST_EQUAL = 10_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` draws without replacement are good; exact for populations of any size.

    Beyond numpy's limit: inversion over the mode and 60 standard deviations around it (all mass that doubles can tell from zero).
    """
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, int((sample + 1) * (good + 1) / (total + 2))))
    spread = int(60 * np.sqrt(sample * (good / total) * (bad / total)) + 60)
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(sample - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - sample + k[:-1] + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, len(k) - 1)])


def communication_matrix(block_sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """rows[b, s]: how many rows of block b go to shard s.

    Row sums are the block sizes, column sums are equal up to one; given those, the counts have the law that
    they have under a uniformly random permutation of all rows (multivariate hypergeometric, block by block).
    """
    rng = np.random.default_rng(seed)
    total = sum(block_sizes)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rows = np.zeros((len(block_sizes), n_shards), dtype=np.int64)
    for b, size in enumerate(block_sizes):
        left, others = size, sum(room)
        for s in range(n_shards):
            others -= room[s]
            rows[b, s] = drawn = hypergeometric(rng, room[s], others, left)
            room[s] -= drawn
            left -= drawn
    return rows


def shuffled_shards(docs: DataFrame, n_shards: int = 16, seed: int = 7, blocks: int | None = None) -> DataFrame:
    """Deal all rows into shards: sizes differ by one row at most, and every row's place is uniformly random.

    docs needs doc_id and text. Returns doc_id, size (UTF-8 bytes plus one), text_crc32, shard, slot (gapless from 0 in each shard).
    Rows are first dealt to `blocks` blocks by hash (at least 256, else as many as shuffle partitions), permuted there, cut by the
    drawn counts, exchanged, and permuted again. Only ids, sizes and checksums move, never texts.

    A null text has size 1 and checksum 0; a null doc_id is a value like any other; rows that are equal in all three columns are dealt like different ones; where
    there are many of them (over MOST_EQUAL), a number that the first write froze spreads them over blocks and parts. An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    blocks = min(MOST_BLOCKS, blocks or max(256, shuffle_partitions(spark)))
    what = ["doc_id", "text_crc32", "size"]
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size") + 1,
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_u"),
    ).toDF("doc_id", "size", "text_crc32", "_u")
    rows = stored(rows.withColumn("_h", F.xxhash64(F.col("doc_id").isNull(), *what)))
    equal = stored(rows.groupBy("_h").count().filter(F.col("count") > MOST_EQUAL).select("_h", F.lit(True).alias("_many")))
    rows = rows.join(small_or_not(equal), "_h", "left").withColumn("_salt", F.when(F.col("_many"), F.col("_u")).otherwise(F.lit(0).cast("long")))
    what = [*what, "_salt"]
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), *what), F.lit(blocks)).cast("int"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_block").count().collect()}  # at most `blocks` rows
    order = sorted(sizes)
    ends = np.cumsum(communication_matrix([sizes[b] for b in order], n_shards, seed), axis=1)
    cuts = spark.createDataFrame([(b, [int(x) for x in e]) for b, e in zip(order, ends)], "_block int, _ends array<long>")
    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), *what), *what)
    rows = (
        rows.withColumn("_at", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), "_block")
        .select(*what, F.size(F.filter("_ends", lambda e: e <= F.col("_at"))).alias("shard"))
    )
    # The second permutation: places follow a random 64-bit key; its top bits cut each shard into parts for separate tasks.
    parts = max(1, blocks // n_shards)
    rows = stored(rows.withColumn("_key", F.xxhash64(F.lit(seed), F.lit("shard"), *what)).withColumn("_part", F.pmod(F.shiftright("_key", 32), F.lit(parts))))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_part").orderBy("_key", *what)
    return (
        rows.withColumn("_n", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "_part"])  # at most max(blocks, n_shards) rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_n")).cast("long").alias("slot"))
    )

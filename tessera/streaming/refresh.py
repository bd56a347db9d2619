"""Refresh and repair: a stream of found hashes against stored ones, and jobs that are tried again until both sides agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.integrity import after_failure
from tessera.operators.lineage import written
from tessera.sources import grouped
from tessera.sources.sinks import IncompleteGeneration

#: Groups of sources: what a batch writes anew.
GROUPS = 16


def _parts(spark: SparkSession, folder: str) -> list:
    try:
        return grouped.manifest(spark, folder)
    except IncompleteGeneration:
        return []


def known(spark: SparkSession, folder: str) -> DataFrame:
    """source, hash, at: the newest hash of each source that has been seen."""
    return grouped.read(spark, folder, _parts(spark, folder), "hashes", "source string, hash string, at timestamp, group int")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """source, hash, reason, batch: the refreshes that batches have asked for."""
    return grouped.read(spark, folder, _parts(spark, folder), "jobs", "source string, hash string, reason string, batch long, group int")


def apply_batch(found: DataFrame, batch: int, folder: str) -> None:
    """One micro-batch of found hashes (source, hash, at): the newest of each source becomes the known one, if it isn't older than that, and a changed or new hash asks for one refresh.

    Rows are written as the version of the batch's number, and count once the manifest names it. A batch that was killed before that writes the same files again; one that was applied is left as it is.
    """
    spark = found.sparkSession
    parts, version = _parts(spark, folder), batch + 1
    if any(p["version"] >= version for p in parts):
        return
    newest = found.filter("source is not null").groupBy("source").agg(F.max_by("hash", F.struct("at", "hash")).alias("hash"), F.max("at").alias("at"))
    newest = written(newest.withColumn("group", F.pmod(F.xxhash64("source"), F.lit(GROUPS)).cast("int")))
    touched = {r["group"] for r in newest.select("group").distinct().collect()}
    stored = grouped.read(spark, folder, [p for p in parts if p["group"] in touched], "hashes", "source string, hash string, at timestamp, group int")
    both = written(newest.join(stored.select("source", F.col("hash").alias("_h"), F.col("at").alias("_at")), "source", "full_outer").withColumn("group", F.pmod(F.xxhash64("source"), F.lit(GROUPS)).cast("int")))
    fresh = F.col("at").isNotNull() & (F.col("_at").isNull() | (F.col("at") >= F.col("_at")))
    after = both.select("source", F.when(fresh, F.col("hash")).otherwise(F.col("_h")).alias("hash"), F.when(fresh, F.col("at")).otherwise(F.col("_at")).alias("at"), "group")
    reason = F.when(F.col("_at").isNull(), "no_existing_hash").when(~F.col("hash").eqNullSafe(F.col("_h")), "content_changed")
    asked = both.filter(fresh).withColumn("reason", reason).filter("reason is not null").select("source", "hash", "reason", F.lit(batch).cast("long").alias("batch"), "group")
    kept = [(p["kind"], p["group"], p["version"]) for p in parts if p["kind"] == "jobs" or p["kind"] == "hashes" and p["group"] not in touched]
    grouped.publish(spark, folder, GROUPS, version, kept + grouped.write(after, folder, "hashes", version, "source") + grouped.write(asked, folder, "jobs", version, "source"))


def refreshed(found: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A query that applies a stream of found hashes (source, hash, at) until all that is there is taken."""
    return found.writeStream.foreachBatch(lambda rows, n: apply_batch(rows, n, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def repair_round(jobs: DataFrame, differing: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """jobs (key, status, attempts, due) after those that are due (QUEUED or RETRY) have been carried out: DONE where the sides agree since, else RETRY after a growing wait, or DEAD after `most` attempts.
    differing (key): what reconcile() finds then."""
    marked = jobs.join(differing.select("key").distinct().withColumn("_still", F.lit(True)), "key", "left")
    due = F.col("status").isin("QUEUED", "RETRY") & (F.col("due") <= now)
    status, wait = after_failure(F.col("attempts") + 1, F.lit(most), F.lit(False))
    done = F.col("_still").isNull()
    return marked.select(
        "key", F.when(~due, F.col("status")).when(done, "DONE").otherwise(status).alias("status"), (F.col("attempts") + due.cast("int")).alias("attempts"),
        F.when(due & ~done & (status == "RETRY"), now + F.make_dt_interval(mins=wait)).otherwise(F.col("due")).alias("due"),
    )

"""Reconciliation, versions, generations, retention, leases and audit chains."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import folds

# Limits of jobs, in seconds where they are times.
STALE_AFTER, LEAST_TIMEOUT, DEFAULT_SLA_MS = 15 * 60, 15 * 60, 300_000


def reconcile(active: DataFrame, physical: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: `missing` for active rows that aren't physical, `orphan` for physical ones that aren't active."""
    a, p = active.select(*keys).distinct(), physical.select(*keys).distinct()
    return a.join(p, keys, "left_anti").withColumn("state", F.lit("missing")).unionByName(p.join(a, keys, "left_anti").withColumn("state", F.lit("orphan")))


def new_jobs(wanted: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted jobs without a pending one (QUEUED, RUNNING or RETRY) of the same keys."""
    pending = jobs.filter(F.col("status").isin("QUEUED", "RUNNING", "RETRY")).select(*keys).distinct()
    return wanted.select(*keys).distinct().join(pending, keys, "left_anti")


def version_diff(old: DataFrame, new: DataFrame, key: str, item: str) -> DataFrame:
    """key, item, change: items of one version that the other lacks; repeated ones stay repeated."""
    gone = old.join(new.select(key, item).distinct(), [key, item], "left_anti").select(key, item, F.lit("removed").alias("change"))
    came = new.join(old.select(key, item).distinct(), [key, item], "left_anti").select(key, item, F.lit("added").alias("change"))
    return gone.unionByName(came)


def changes(stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, reason: stored hashes (key, hash) against those found (key, hash)."""
    joined = stored.select(key, F.col("hash").alias("_s"), F.lit(True).alias("_k")).join(found.select(key, F.col("hash").alias("_f")), key, "full_outer")
    reason = F.when(F.col("_f").isNull(), "file_not_found").when(F.col("_s").isNull(), "no_existing_hash").when(F.col("_s") == F.col("_f"), "content_unchanged").otherwise("content_changed")
    return joined.select(key, reason.alias("reason"))


def activate(rows: DataFrame, pointers: DataFrame, key: str) -> DataFrame:
    """rows (key, generation, status) with status as after activating each key's generation in pointers (key, generation): it is ACTIVE, other active ones SUPERSEDED."""
    joined = rows.join(pointers.select(key, F.col("generation").alias("_g")), key, "left")
    status = F.when(F.col("_g").isNull(), F.col("status")).when(F.col("generation") == F.col("_g"), "ACTIVE").when(F.col("status") == "ACTIVE", "SUPERSEDED").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_g")


def chain_hash(previous: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, *parts).cast("binary"), 256)


def chained(entries: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """entries with previous_hash and entry_hash: each key's entries in order, each hash covering the one before. Streamed with the last hash as the only state."""

    def step(before: str, rows: pa.RecordBatch) -> tuple[str, tuple[list, list]]:
        previous, made = [], []
        for o, p in zip(rows.column("_o").to_pylist(), rows.column("_p").to_pylist()):
            previous.append(before)
            before = hashlib.sha256("|".join(x for x in (before, o, p) if x is not None).encode()).hexdigest()
            made.append(before)
        return before, (previous, made)

    rows = entries.withColumn("_o", F.col(order).cast("string")).withColumn("_p", F.col(payload).cast("string"))
    keep = [key, order, *(c for c in entries.columns if c not in (key, order))]
    return folds.running(rows, key, [order, "_p"], keep, {"previous_hash": "string", "entry_hash": "string"}, lambda: "genesis", step)


def broken_links(chain: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Entries whose hash isn't that of their content, or whose previous hash isn't the one before: a window, no fold."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(key).orderBy(order)), F.lit("genesis"))
    good = (F.col("previous_hash") == before) & (F.col("entry_hash") == chain_hash(F.col("previous_hash"), F.col(order).cast("string"), F.col(payload).cast("string")))
    return chain.withColumn("_ok", good).filter(~F.col("_ok")).drop("_ok")


def after_failure(attempts: Column, most: Column, permanent: Column, cap_minutes: int = 30, cap_power: int = 5) -> tuple[Column, Column]:
    """Status and minutes to wait after a failure: DEAD when permanent or out of attempts, else RETRY after 2^attempts minutes, capped."""
    dead = permanent | (attempts >= most)
    wait = F.least(F.lit(cap_minutes), F.pow(F.lit(2.0), F.least(F.greatest(attempts, F.lit(1)), F.lit(cap_power))).cast("int"))
    return F.when(dead, "DEAD").otherwise("RETRY"), F.when(~dead, wait)


def timed_out(age_seconds: Column, sla_ms: Column) -> Column:
    """Whether a running task has been silent for over 15 minutes and for twice its agreed time."""
    limit = F.greatest(F.coalesce(sla_ms, F.lit(DEFAULT_SLA_MS)) * 2 / 1000, F.lit(LEAST_TIMEOUT))
    return (age_seconds > STALE_AFTER) & (age_seconds >= limit)


def retained(rows: DataFrame, at: str, kind: str, now: Column, days: dict[str, int]) -> DataFrame:
    """Rows whose kind has no limit or whose age is within it."""
    limit = F.create_map(*[F.lit(x) for pair in days.items() for x in pair])
    age = F.datediff(now.cast("date"), F.to_date(at))
    return rows.filter(F.coalesce(age <= F.try_element_at(limit, F.col(kind)), F.lit(True)))


def upserted(existing: DataFrame, replacements: DataFrame, key: list[str]) -> DataFrame:
    """existing with the rows of replacements in place of those with the same key."""
    return existing.join(replacements.select(*key).distinct(), key, "left_anti").unionByName(replacements)

"""Refreshes that are applied once, and repairs until both sides agree."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import integrity
from tessera.sources import grouped
from tessera.streaming import refresh

SCHEMA = "source string, hash string, at timestamp"


def at(n):
    return datetime(2024, 1, 1) + timedelta(minutes=n)


BATCHES = [
    [("a", "1", at(0)), ("b", "1", at(0)), ("c", "1", at(0)), ("c", "2", at(1)), (None, "x", at(0))],
    [("a", "1", at(5)), ("b", "2", at(5)), ("d", "1", at(5)), ("c", "0", at(0))],
    [("b", "3", at(9)), ("b", "3", at(8)), ("a", "9", at(9))],
]
HASHES = {"a": "9", "b": "3", "c": "2", "d": "1"}
JOBS = {("a", "1", "no_existing_hash", 0), ("b", "1", "no_existing_hash", 0), ("c", "2", "no_existing_hash", 0), ("b", "2", "content_changed", 1), ("d", "1", "no_existing_hash", 1), ("b", "3", "content_changed", 2), ("a", "9", "content_changed", 2)}


def result(spark, folder):
    return {r["source"]: r["hash"] for r in refresh.known(spark, folder).collect()}, sorted((r["source"], r["hash"], r["reason"], r["batch"]) for r in refresh.jobs(spark, folder).collect())


def test_a_killed_batch_leaves_one_result(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "state")
    for n, rows in enumerate(BATCHES):
        batch = spark.createDataFrame(rows, SCHEMA)
        with monkeypatch.context() as m:  # killed when its files are written
            m.setattr(grouped, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                refresh.apply_batch(batch, n, folder)
        for _ in range(2):  # run again, and once more after it was applied but not noted by the stream
            refresh.apply_batch(batch, n, folder)
    assert result(spark, folder) == (HASHES, sorted(JOBS))


def test_refresh_as_a_stream(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    for rows in BATCHES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        q = refresh.refreshed(spark.readStream.schema(SCHEMA).parquet(source), folder, str(tmp_path / "c"))
        assert q.awaitTermination(120)
    assert result(spark, folder) == (HASHES, sorted(JOBS))


def test_repairs_until_both_sides_agree(spark):
    active = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    jobs = spark.createDataFrame([(k, "QUEUED", 0, at(0)) for k in "abcd"] + [("e", "DONE", 1, at(0))], "key string, status string, attempts int, due timestamp")
    arrives, minute, seen = {"a": 1, "b": 3, "c": 99, "d": 2}, 0, []
    for n in range(1, 6):  # each round's rebuild brings those whose turn it is
        physical = spark.createDataFrame([(k,) for k in "abcd" if arrives[k] <= n] or [("-",)], "key string").filter("key <> '-'")
        differing = integrity.reconcile(active, physical, ["key"]).filter("state = 'missing'")
        jobs = spark.createDataFrame(refresh.repair_round(jobs, differing, F.lit(at(minute)), 4).collect(), jobs.schema)
        seen.append({r["key"]: (r["status"], r["attempts"]) for r in jobs.collect()})
        minute += 40
    assert seen[0] == {"a": ("DONE", 1), "b": ("RETRY", 1), "c": ("RETRY", 1), "d": ("RETRY", 1), "e": ("DONE", 1)}
    assert seen[-1] == {"a": ("DONE", 1), "b": ("DONE", 3), "c": ("DEAD", 4), "d": ("DONE", 2), "e": ("DONE", 1)}
    waiting = refresh.repair_round(spark.createDataFrame([("x", "RETRY", 2, at(10))], jobs.schema), active.limit(0), F.lit(at(5))).first()
    assert (waiting["status"], waiting["attempts"]) == ("RETRY", 2)

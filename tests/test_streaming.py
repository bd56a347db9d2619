"""Stateful operators against brute force, as batches and as streams."""

from collections import defaultdict

from pyspark.sql import functions as F

from tessera.streaming import limits

SF = "/root/testdata/sf0.001"


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def brute_limiter(rows, limit, window):
    out, logs = {}, defaultdict(list)
    for e, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        near = [x for x in logs[u] if x > t - window]
        out[e] = len(near) < limit
        if out[e]:
            logs[u].append(t)
    return out


def micros(spark):
    return [tuple(r) for r in events(spark).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp"))).collect()]


def test_rejected_requests_dont_count():
    assert limits.admitted([0, 1, 2, 3, 11, 12], [], 2, 10) == ([True, True, False, False, True, True], [11, 12])


def test_rate_limiter_batch(spark):
    got = {r["event_id"]: r["admitted"] for r in limits.rate_limited(events(spark), "user_id", "ts", "event_id", 2, 36000).collect()}
    assert got == brute_limiter(micros(spark), 2, 36000 * 10**6) and not all(got.values())


def test_rate_limiter_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark).orderBy("ts").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events(spark).schema).parquet(source)
    out = limits.rate_limited(stream, "user_id", "ts", "event_id", 2, 36000)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["event_id"]: r["admitted"] for r in spark.table("limited").collect()} == brute_limiter(micros(spark), 2, 36000 * 10**6)


def test_tumbling_stream_matches_batch_but_for_the_open_window(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events(spark).schema).parquet(source)
    q = limits.tumbling(stream, "ts", "1 day", "event_type", "error").writeStream.format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("tumbled").collect()}
    want = {tuple(r) for r in limits.tumbling(events(spark), "ts", "1 day", "event_type", "error").collect()}
    last = max(r[0] for r in want)
    assert {r for r in want if r[0] < last} <= got <= want


def test_breaker(spark):
    calls = [(1, i, t, f) for i, (t, f) in enumerate([(0, True), (1, True), (2, True), (3, False), (20, False), (40, True), (41, False), (75, False), (76, True)])]
    df = spark.createDataFrame(calls, "k int, n long, s long, f boolean").withColumn("ts", F.timestamp_seconds("s"))
    out = limits.breaker_states(df, "k", "n", "ts", "f", 3, 30).orderBy("n").collect()
    assert [r["state"] for r in out] == ["closed"] * 3 + ["open", "open", "half_open", "open", "half_open", "closed"]


def test_first_seen(spark):
    got = limits.first_seen(events(spark), ["user_id"], "ts")
    assert got.count() == events(spark).select("user_id").distinct().count()

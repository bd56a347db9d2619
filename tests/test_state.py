"""Ordered state on streams against batches, alerts against plain loops, memories against brute force."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import alerts, memories
from tessera.plans import streams
from tessera.streaming import limits

SF = "/root/testdata/sf0.001"


def streamed(spark, rows, ts, tmp_path, of, files=4):
    """What a stream gives that reads rows in some files, in the order of time but for neighbours, and the watermark at its end."""
    source = str(tmp_path / f"in-{uuid.uuid4().hex}")
    ordered = rows.orderBy(ts).collect()
    for i in range(files):
        part = ordered[i * len(ordered) // files : (i + 1) * len(ordered) // files]
        random.Random(i).shuffle(part)  # within a file, any order
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(source)
    name = f"out_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = of(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    state = [s for p in q.recentProgress for s in p["stateOperators"]]
    return spark.table(name).collect(), state


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").filter("user_id < 12")


def before(spark, events, minutes=10):
    """Events that the watermark has passed at the end."""
    return events.filter(F.col("ts") <= events.agg(F.max("ts")).first()[0] - F.expr(f"interval {minutes} minutes"))


@pytest.mark.parametrize("kind", ["limiter", "breaker", "quota"])
def test_streams_give_what_batches_do(spark, tmp_path, events, kind):
    calls = events.withColumn("bad", F.col("event_type").isin("error", "view")).withColumn("cost", F.round("value").cast("long"))
    of = {
        "limiter": lambda df: limits.rate_limited(df, "user_id", "ts", "event_id", 2, 36000),
        "breaker": lambda df: limits.breaker_states(df, "user_id", "event_id", "ts", "bad", 2, 86400),
        "quota": lambda df: limits.daily_quota(df, "user_id", "ts", "event_id", "cost", 60).select("user_id", "event_id", "spent", "allowed"),
    }[kind]
    got, state = streamed(spark, calls, "ts", tmp_path, of)
    want = of(calls).join(before(spark, calls).select("event_id"), "event_id", "left_semi").select(*got[0].asDict()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100
    assert state[-1]["numRowsTotal"] < 200  # logs that count no more, days that are over and closed breakers are let go


def test_alert_states(spark):
    rng = random.Random(4)
    rows = [(a, at, rng.random() < 0.7) for a in "xy" for at in range(60) if rng.random() < 0.9]
    got = {(r["alert"], r["at"]): r["state"] for r in alerts.alert_states(spark.createDataFrame(rows, "alert string, at long, breached boolean"), "alert", F.lit(3)).collect()}
    want, since, last = {}, {}, {}
    for a, at, hit in sorted(rows):
        since[a] = None if not hit else at if since.get(a) is None or last[a] != at - 1 else since[a]
        last[a] = at
        want[a, at] = "inactive" if since[a] is None else "firing" if at - since[a] >= 3 else "pending"
    assert got == want and set(want.values()) == {"inactive", "pending", "firing"}


def test_alert_states_on_a_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = [("x", at, rng.random() < 0.7) for at in range(200)]
    df = spark.createDataFrame(rows, "alert string, at long, breached boolean").withColumn("ts", F.timestamp_seconds(86_400 + F.col("at") * 3600))
    begin, step, fades = alerts.alert_steps(3)
    of = lambda s: limits.in_order(s.select("alert", "at", "breached", F.unix_micros("ts").alias("_t")), "alert", "1 hour", ["_t"], ["at"], {"state": "string"}, begin, step, fades)
    got, _ = streamed(spark, df, "ts", tmp_path, of)
    want = {(r["at"], r["state"]) for r in alerts.alert_states(df, "alert", F.lit(3)).collect()}
    assert {(r["at"], r["state"]) for r in got} == {x for x in want if x[0] <= 198} and len(got) == 199


def test_increases_and_rates(spark):
    rows = [("a", 0, 5), ("a", 30, 9), ("a", 70, 2), ("a", 100, 2), ("b", 10, 1), ("b", 130, 4)]
    df = spark.createDataFrame(rows, "s string, t long, v long").withColumn("ts", F.timestamp_seconds("t"))
    up = alerts.increases(df, ["s"], "ts", "v")
    assert [r["increase"] for r in up.orderBy("s", "t").collect()] == [0, 4, 2, 0, 0, 3]
    got = {r["at"]: r["rate"] for r in alerts.rates(up, [], "ts", 60, 2).collect()}
    assert got == {1: 4 / 120, 2: 6 / 120, 3: 5 / 120, 4: 3 / 120}
    last = {r["at"]: r["value"] for r in alerts.gauges(df, ["s"], [], "ts", "v", 60, 2).collect()}
    assert last == {1: 9 + 1, 2: 2 + 1, 3: 2 + 4, 4: 4}


def test_histogram_quantiles(spark):
    rng = random.Random(2)
    values = [(k, rng.choice([0.01, 0.3, 0.7, 3.0, 15.0, 80.0]) * rng.random()) for k in range(4) for _ in range(50)] + [(9, 70.0)] * 3
    counted = alerts.in_buckets(spark.createDataFrame(values, "k int, v double"), "v").groupBy("k", "le").agg(F.sum("increase").alias("n"))
    for q in (0.5, 0.95):
        for r in alerts.histogram_quantile(counted, ["k"], "le", "n", q).collect():
            own, bounds = [v for k, v in values if k == r["k"]], [*alerts.LATENCY_BUCKETS, math.inf]
            n = [sum(v <= b for v in own) for b in bounds]
            at = next(i for i, x in enumerate(n) if x >= q * n[-1])
            low, below = (bounds[at - 1], n[at - 1]) if at else (0.0, 0)
            assert r["quantile"] == pytest.approx(bounds[-2] if at == len(bounds) - 1 else low + (bounds[at] - low) * (q * n[-1] - below) / (n[at] - below))


def alike(a, b):
    if a in b or b in a:
        return 1.0
    x, y = ({p + q for p, q in zip(t, t[1:])} for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def test_memories_of_a_thousand_histories(spark, tmp_path):
    rng = random.Random(1)
    stems = ["she likes tea with milk", "he lives in Rome", "works as a nurse", "the cat is called Mo", "drives a red car to work"]
    facts = [(u, i, " ".join(w if rng.random() < 0.8 else rng.choice(["blue", "two", "old", "Oslo"]) for w in rng.choice(stems).split())) for u in range(1000) for i in range(rng.randint(1, 9))]
    facts += [(2000, 0, None), (2000, 1, ""), (2001, 1, "b tie"), (2001, 1, "a tie")]
    shuffled = rng.sample(facts, len(facts))
    df = spark.createDataFrame(shuffled, "user long, turn int, fact string")
    want = []
    for u in {f[0] for f in facts}:
        known = []
        for _, i, f in sorted((f for f in facts if f[0] == u), key=lambda f: (f[1], f[2] or "")):
            best = max(known, key=lambda m: (alike(f, m[1]), -known.index(m))) if known and f else None
            score = alike(f, best[1]) if best else 0.0 if f else 1.0
            action = "NOOP" if score > 0.92 else "UPDATE" if score >= 0.5 else "ADD"
            if action == "UPDATE":
                known.remove(best)
            if action != "NOOP":
                known.append((i, f))
            want.append((u, i, action, best[0] if action == "UPDATE" else None))
    got = [tuple(r) for r in memories.merged(df, "user", "turn", "fact").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {x[2] for x in want} == {"ADD", "UPDATE", "NOOP"}
    timed = df.filter("user < 40").withColumn("ts", F.timestamp_seconds(86_400 + F.col("turn") * 3600 + F.col("user")))
    out, _ = streamed(spark, timed, "ts", tmp_path, lambda s: memories.merged(s, "user", "turn", "fact", "ts"), files=3)
    end = timed.agg(F.max("ts")).first()[0]
    passed = {(r["user"], r["turn"]) for r in timed.filter(F.col("ts") <= F.lit(end) - F.expr("interval 10 minutes")).collect()}
    assert sorted(map(str, map(tuple, out))) == sorted(str(w) for w in want if w[:2] in passed) and len(out) > 100


def test_registered_alerts_have_all_states(spark):
    rows = streams.alert_states(spark, "/root/testdata/sf0.01").groupBy("alert", "state").count().collect()
    assert {r["alert"] for r in rows} == {"HighErrorRate", "RetrievalEmptySpike", "IndexDrift", "IngestionBacklog", "P95LatencyHigh"}
    assert {r["state"] for r in rows} == {"inactive", "pending", "firing"}

"""Rate limits, quotas, breakers and tumbling counts, as streams and as batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.streaming.ordered import in_order

#: How late events may be.
WATERMARK = "10 minutes"


def admitted(times: list[int], log: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Whether each time (in order) is admitted when at most `limit` admitted ones lie in the `window` before it, and the log of those that still count."""
    out = []
    for t in times:
        log = [x for x in log if x > t - window]
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return out, log


def rate_limited(events: DataFrame, key: str, ts: str, event: str, limit: int, window_seconds: int) -> DataFrame:
    """key, event, admitted for a stream or a batch of events; rejected ones aren't counted against later ones.

    The state of a key is its log of at most `limit` times. On a stream, events wait until the watermark has passed them, so results are those of the batch; a log whose times count no more is let go.
    """
    micros = events.select(key, event, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    window = window_seconds * 1_000_000

    def step(log: list, rows: pa.RecordBatch) -> tuple[list, tuple[list]]:
        ok, log = admitted([float("nan") if t is None else t for t in rows.column("_t").to_pylist()], log, limit, window)
        return log, (ok,)

    def fades(log: list, now: int) -> tuple[list | None, int | None]:
        log = [t for t in log if t > now - window]
        return (log, log[-1] + window) if log else (None, None)

    if events.isStreaming:
        return in_order(micros, key, WATERMARK, ["_t", event], [event], {"admitted": "boolean"}, list, step, fades)
    return folds.running(micros, key, [F.asc_nulls_last("_t"), F.asc_nulls_last(event)], [key, event], {"admitted": "boolean"}, list, step)


DAY = 86_400 * 1_000_000


def daily_quota(events: DataFrame, key: str, ts: str, order: str, cost: str, quota: int) -> DataFrame:
    """events with day, spent (before the event) and allowed: an event is allowed while something is left of the day's quota, which it may then pass once. Days are those of UTC.

    As refused events cost nothing and nothing is left once the quota is passed, the sum of all costs before an event decides. On a stream (key, order, spent, allowed) that sum is a key's state until its day is over.
    """
    if events.isStreaming:

        def step(state: list, rows: pa.RecordBatch) -> tuple[list, tuple[list, list]]:
            day, spent = state
            before = []
            for t, c in zip(rows.column("_t").to_pylist(), rows.column("_c").to_pylist()):
                day, spent = (day, spent) if t // DAY == day else (t // DAY, 0)
                before.append(spent)
                spent += c or 0
            return [day, spent], (before, [x < quota for x in before])

        def fades(state: list, now: int) -> tuple[list | None, int | None]:
            return (None, None) if state[0] is None or now >= (state[0] + 1) * DAY else (state, (state[0] + 1) * DAY)

        few = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(cost).cast("long").alias("_c"))
        return in_order(few, key, WATERMARK, ["_t", order], [order], {"spent": "long", "allowed": "boolean"}, lambda: [None, 0], step, fades)
    day = Window.partitionBy(key, "day").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("day", F.to_date(ts)).withColumn("spent", F.coalesce(F.sum(cost).over(day), F.lit(0)))
    return out.withColumn("allowed", F.col("spent") < quota)


def tumbling(events: DataFrame, ts: str, width: str, by: str, bad: str) -> DataFrame:
    """start, by, n, failed per window; on a stream, windows come out once the watermark has passed them."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_ts", WATERMARK)
    counted = timed.groupBy(F.window("_ts", width).alias("_w"), by).agg(F.count("*").alias("n"), F.count_if(F.col(by) == bad).alias("failed"))
    return counted.select(F.col("_w.start").cast("timestamp_ntz").alias("start"), by, "n", "failed")


def breaker_states(calls: DataFrame, key: str, order: str, ts: str, failed: str, after: int = 3, pause_seconds: int = 30) -> DataFrame:
    """key, order, state (closed, open, half_open) before each call: open after so many failures in a row, half open once the pause is over. Calls while open aren't
    made and change nothing; a success closes it, a failure when half open opens it again. Folded per key in order, as what is made depends on the state. On a stream, calls wait until the watermark has
    passed them; a closed breaker without failures is no state."""
    few = calls.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(failed).alias("_f"))

    def step(now: tuple, rows: pa.RecordBatch) -> tuple[tuple, tuple[list]]:
        failures, opened = now
        out = []
        for t, bad in zip(rows.column("_t").to_pylist(), rows.column("_f").to_pylist()):
            t = float("nan") if t is None else t
            state = "closed" if opened is None else "half_open" if t - opened >= pause_seconds * 1_000_000 else "open"
            out.append(state)
            if state != "open":
                failures = failures + 1 if bad else 0
                opened = t if bad and (failures >= after or state == "half_open") else None
        return (failures, opened), (out,)

    if calls.isStreaming:
        return in_order(few, key, WATERMARK, ["_t", order], [order], {"state": "string"}, lambda: (0, None), step, lambda now, _: (None if tuple(now) == (0, None) else now, None))
    return folds.running(few, key, [F.asc_nulls_last("_t"), F.asc_nulls_last(order)], [key, order], {"state": "string"}, lambda: (0, None), step)


def first_seen(events: DataFrame, keys: list[str], ts: str, *ties: str) -> DataFrame:
    """Each key's first event, by time and then `ties`; on a stream, repetitions are dropped within the watermark."""
    if events.isStreaming:
        return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", WATERMARK).dropDuplicatesWithinWatermark(keys)
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(ts, *ties))).filter("_r = 1").drop("_r")

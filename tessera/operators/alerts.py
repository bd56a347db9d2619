"""Alerts over sampled metrics: increases of counters, rates, quantiles of histograms, gauges, and the states of alerts over time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the latency histogram's buckets, in seconds; one without a bound follows.
LATENCY_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0)


def increases(samples: DataFrame, series: list[str], ts: str, value: str, *ties: str) -> DataFrame:
    """samples of counters with `increase` since the series' sample before (0 for its first one). A value below the one before is that of a counter that began again."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(ts, *ties))
    return samples.withColumn("increase", F.when(before.isNull(), F.col(value) * 0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value)))


def evaluated(rows: DataFrame, ts: str, step_seconds: int, steps: int) -> DataFrame:
    """rows once for each evaluation `at` (its number: at * step_seconds after 1970) in whose window of `steps` steps before it they lie. A range as equal keys: no window frame and no grid of times."""
    first = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (step_seconds * 1_000_000)).cast("long") + 1
    return rows.withColumn("_f", first).withColumn("at", F.explode(F.sequence(F.col("_f"), F.col("_f") + steps - 1))).drop("_f")


def rates(increased: DataFrame, by: list[str], ts: str, step_seconds: int, steps: int) -> DataFrame:
    """by, at, rate: the increase a second within the window before each evaluation, whole window counted (no extrapolation to its edges). Evaluations without samples have no row."""
    return evaluated(increased, ts, step_seconds, steps).groupBy(*by, "at").agg((F.sum("increase") / (step_seconds * steps)).alias("rate"))


def gauges(samples: DataFrame, series: list[str], by: list[str], ts: str, value: str, step_seconds: int, steps: int, *ties: str) -> DataFrame:
    """by, at, value: the sum over the series of the last value of each within the window before an evaluation."""
    last = evaluated(samples, ts, step_seconds, steps).groupBy(*series, "at").agg(F.max_by(value, F.struct(ts, *ties)).alias("_v"))
    return last.groupBy(*by, "at").agg(F.sum("_v").alias("value"))


def in_buckets(observed: DataFrame, value: str, bounds: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """observed once for each cumulative bucket (le; infinity at the end), with `increase`: 1 if it counts there, else 0, so that no bucket is missing."""
    every = F.array(*[F.lit(b) for b in bounds], F.lit(float("inf")))
    return observed.withColumn("le", F.explode(every)).withColumn("increase", (F.col(value) <= F.col("le")).cast("long"))


def histogram_quantile(buckets: DataFrame, by: list[str], le: str, count: str, q: float) -> DataFrame:
    """by, quantile from cumulative buckets (le, count): linear within the bucket that holds it; the greatest bound but one if it lies beyond all bounds; null if nothing is counted."""
    lists = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col(count).cast("double").alias("n")))).alias("_b"))
    rank = F.element_at("_b", -1)["n"] * q
    at = F.size(F.filter("_b", lambda b: b["n"] < rank))  # cumulative, so the first that reaches the rank follows those below it
    end, last = F.get("_b", at), F.size("_b") - 1
    begin, below = F.when(at > 0, F.get("_b", at - 1)["le"]).otherwise(0.0), F.when(at > 0, F.get("_b", at - 1)["n"]).otherwise(0.0)
    inside = begin + (end["le"] - begin) * (rank - below) / (end["n"] - below)
    return lists.select(*by, F.when(F.element_at("_b", -1)["n"] > 0, F.when(at >= last, F.get("_b", last - 1)["le"]).otherwise(inside)).alias("quantile"))


def alert_states(evaluations: DataFrame, by: str, for_steps: Column) -> DataFrame:
    """by, at, state of evaluations (by, at, breached): inactive if not breached, else pending, and firing once it has been breached at every evaluation for so many steps; a missing evaluation ends that."""
    held = evaluations.withColumn("_for", for_steps).withColumn("_hit", F.coalesce("breached", F.lit(False)))
    run = F.col("at") - F.row_number().over(Window.partitionBy(by, "_hit").orderBy("at"))
    since = F.col("at") - F.min("at").over(Window.partitionBy(by, "_hit", "_run"))
    state = F.when(~F.col("_hit"), "inactive").when(since >= F.col("_for"), "firing").otherwise("pending")
    return held.withColumn("_run", run).select(by, "at", state.alias("state"))


def alert_steps(for_steps: int):
    """begin, step and fades of alert_states() as a fold over an alert's evaluations in order, for streams: the state is where the breach began and the last evaluation."""

    def step(state: list, rows: pa.RecordBatch) -> tuple[list, tuple[list]]:
        since, last, out = *state, []
        for at, hit in zip(rows.column("at").to_pylist(), rows.column("breached").to_pylist()):
            since = None if not hit else at if since is None or at != last + 1 else since
            last = at
            out.append("inactive" if since is None else "firing" if at - since >= for_steps else "pending")
        return [since, last], (out,)

    return lambda: [None, None], step, lambda state, now: (None if state[0] is None else state, None)


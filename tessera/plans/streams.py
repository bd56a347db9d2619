"""Queries of the stateful operators, in batch form; tests run them as streams as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import alerts
from tessera.operators.lineage import written
from tessera.plans.registry import query
from tessera.sources.tables import table
from tessera.streaming import limits


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, true AS admitted, [t] AS log FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, len(k) < 3, CASE WHEN len(k) < 3 THEN list_append(k, e.t) ELSE k END FROM e JOIN w ON e.user_id = w.user_id AND e.i = w.i + 1, LATERAL (SELECT list_filter(w.log, lambda x: x > e.t - 7200000000) AS k))
SELECT user_id, event_id, admitted FROM w""")
def rate_limiter(spark: SparkSession, sf: str) -> DataFrame:
    """At most 3 admitted events a user in any two hours. A test holds it against brute force as well."""
    return limits.rate_limited(table(spark, sf, "events"), "user_id", "ts", "event_id", 3, 7200)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type IN ('error', 'view') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, '' AS state, 0 AS failures, CAST(NULL AS BIGINT) AS opened FROM e
  UNION ALL SELECT e.user_id, e.event_id, e.i, s, CASE WHEN s = 'open' THEN w.failures WHEN e.bad THEN w.failures + 1 ELSE 0 END,
    CASE WHEN s = 'open' THEN w.opened WHEN e.bad AND (w.failures + 1 >= 3 OR s = 'half_open') THEN e.t END
  FROM e JOIN w ON e.user_id = w.user_id AND e.i = w.i + 1, LATERAL (SELECT CASE WHEN w.opened IS NULL THEN 'closed' WHEN e.t - w.opened >= 86400000000 THEN 'half_open' ELSE 'open' END AS s))
SELECT user_id, event_id, state FROM w WHERE i > 0""")
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """A breaker a user over its failures, with a pause of a day. A test holds it against brute force as well."""
    calls = table(spark, sf, "events").withColumn("bad", F.col("event_type").isin("error", "view"))
    return limits.breaker_states(calls, "user_id", "event_id", "ts", "bad", 3, 86400)


@query("""WITH e AS (SELECT event_id, user_id % 10 AS tenant, CAST(ts AS DATE) AS day, ts, CAST(round(value) AS BIGINT) AS cost FROM events)
SELECT event_id, spent, spent < 500 AS allowed FROM (SELECT *, CAST(coalesce(sum(cost) OVER (PARTITION BY tenant, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent FROM e)""")
def token_quota(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", (F.col("user_id") % 10).alias("tenant"), "ts", F.round("value").cast("long").alias("cost"))
    return limits.daily_quota(events, "tenant", "ts", "event_id", "cost", 500).select("event_id", "spent", "allowed")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1, 2""")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return limits.tumbling(table(spark, sf, "events"), "ts", "6 hours", "event_type", "error")


@query("""WITH h AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad, quantile_disc(value, 0.95) AS p FROM events GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, bad * 100 > 22 * n AS error_alert, coalesce(n - lag(n) OVER (ORDER BY d) > 20, false) AS backlog_alert, p > 150 AS latency_alert FROM h""")
def threshold_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts per day; the window over days sees one row a day."""
    from tessera.operators import statistics

    days = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    p95 = statistics.percentiles(days, ["d"], "value", p=statistics.percentile_nearest("value", 0.95)).drop("n")
    counts = days.groupBy("d").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad")).join(p95, "d")
    jump = F.col("n") - F.lag("n").over(Window.orderBy("d")) > 20
    return counts.select(F.date_format("d", "yyyy-MM-dd").alias("day"), (F.col("bad") * 100 > F.col("n") * 22).alias("error_alert"), F.coalesce(jump, F.lit(False)).alias("backlog_alert"), (F.col("p") > 150).alias("latency_alert"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def first_events(spark: SparkSession, sf: str) -> DataFrame:
    return limits.first_seen(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


# The metrics of the alerts, made of events: a counter for each instance and status that begins again after 40, how many chunks an instance misses, queue depths by status, and latencies.
_INSTANCE, _RESETS, STEP = 4, 40, 21_600


@query(f"""WITH s AS (SELECT event_id, ts, user_id % {_INSTANCE} AS inst, event_type AS status, value, user_id, epoch_us(ts) // {STEP}000000 + 1 AS f FROM events),
c AS (SELECT *, (row_number() OVER (PARTITION BY inst, status ORDER BY ts, event_id) - 1) % {_RESETS} + 1 AS v FROM s),
i AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END AS inc FROM (SELECT *, lag(v) OVER (PARTITION BY inst, status ORDER BY ts, event_id) AS p FROM c)),
e AS (SELECT *, f + k AS "at" FROM i, (VALUES (0), (1)) w(k)),
rate AS (SELECT "at", CAST(sum(inc) AS DOUBLE) / {2 * STEP} AS a, CAST(sum(inc) FILTER (WHERE status = 'error') AS DOUBLE) / {2 * STEP} AS b, CAST(sum(inc) FILTER (WHERE status = 'view') AS DOUBLE) / {2 * STEP} AS w FROM e GROUP BY 1),
miss AS (SELECT "at", sum(m) AS m FROM (SELECT "at", inst, CASE WHEN event_id % 9 = 0 THEN user_id % 5 ELSE 0 END AS m, row_number() OVER (PARTITION BY inst, "at" ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1 GROUP BY 1),
queue AS (SELECT "at", sum(d) AS d FROM (SELECT "at", inst, status, CAST(round(value) AS BIGINT) AS d, row_number() OVER (PARTITION BY inst, status, "at" ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE status IN ('click', 'view')) WHERE r = 1 GROUP BY 1),
le AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0, 'inf'::DOUBLE]::DOUBLE[]) AS le),
bucket AS (SELECT "at", le, CAST(sum(CASE WHEN value / 20 <= le THEN 1 ELSE 0 END) AS DOUBLE) / {2 * STEP} AS n FROM e, le GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "at" ORDER BY le) AS k, count(*) OVER (PARTITION BY "at") AS ks, max(n) OVER (PARTITION BY "at") * 0.95::DOUBLE AS rank, lag(n, 1, 0) OVER (PARTITION BY "at" ORDER BY le) AS below, lag(le, 1, 0) OVER (PARTITION BY "at" ORDER BY le) AS low FROM bucket),
p95 AS (SELECT "at", CASE WHEN k = ks THEN low ELSE low + (le - low) * (rank - below) / (n - below) END AS q FROM (SELECT *, row_number() OVER (PARTITION BY "at" ORDER BY le) AS r FROM ranked WHERE n >= rank) WHERE r = 1),
v AS (SELECT 'HighErrorRate' AS alert, "at", 2 AS n, coalesce(b, 0) / greatest(a, CAST(0.0001 AS DOUBLE)) > CAST(0.21 AS DOUBLE) AS hit FROM rate
  UNION ALL SELECT 'RetrievalEmptySpike', "at", 2, w > CAST(0.0008 AS DOUBLE) FROM rate WHERE w IS NOT NULL UNION ALL SELECT 'IndexDrift', "at", 1, m > 0 FROM miss UNION ALL SELECT 'IngestionBacklog', "at", 2, d > 250 FROM queue
  UNION ALL SELECT 'P95LatencyHigh', "at", 3, q > CAST(7.5 AS DOUBLE) FROM p95),
g AS (SELECT *, "at" - row_number() OVER (PARTITION BY alert, hit ORDER BY "at") AS run FROM v)
SELECT alert, "at", CASE WHEN NOT hit THEN 'inactive' WHEN "at" - min("at") OVER (PARTITION BY alert, hit, run) >= n THEN 'firing' ELSE 'pending' END AS state FROM g""")
def alert_states(spark: SparkSession, sf: str) -> DataFrame:
    """Five alerts every six hours over the twelve hours before: share of errors, empty retrievals, missing chunks, backlog and p95 latency; pending until they have held long enough."""
    return alerts.alert_states(evaluations(spark, sf), "alert", F.expr("map('HighErrorRate', 2, 'RetrievalEmptySpike', 2, 'IndexDrift', 1, 'IngestionBacklog', 2, 'P95LatencyHigh', 3)[alert]"))


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """alert, at, breached."""
    seen = table(spark, sf, "events").select("event_id", "ts", "user_id", "value", (F.col("user_id") % _INSTANCE).alias("inst"), F.col("event_type").alias("status"))
    order = Window.partitionBy("inst", "status").orderBy("ts", "event_id")
    counted = written(alerts.increases(seen.withColumn("v", (F.row_number().over(order) - 1) % _RESETS + 1), ["inst", "status"], "ts", "v", "event_id"))
    rate = lambda rows, *by: alerts.rates(rows, list(by), "ts", STEP, 2)
    both = rate(counted).join(rate(counted.filter("status = 'error'")).withColumnRenamed("rate", "_bad"), "at", "left")
    missing = alerts.gauges(seen.withColumn("m", F.when(F.col("event_id") % 9 == 0, F.col("user_id") % 5).otherwise(0)), ["inst"], [], "ts", "m", STEP, 2, "event_id")
    depth = alerts.gauges(seen.filter("status in ('click', 'view')").withColumn("d", F.round("value").cast("long")), ["inst", "status"], [], "ts", "d", STEP, 2, "event_id")
    latency = alerts.in_buckets(seen.withColumn("s", F.col("value") / 20), "s")
    p95 = alerts.histogram_quantile(rate(latency, "le"), ["at"], "le", "rate", 0.95)
    named = lambda rows, name, breached: rows.select(F.lit(name).alias("alert"), "at", breached.alias("breached"))
    return (
        named(both, "HighErrorRate", F.coalesce("_bad", F.lit(0.0)) / F.greatest("rate", F.lit(0.0001)) > 0.21)
        .unionByName(named(rate(counted.filter("status = 'view'")), "RetrievalEmptySpike", F.col("rate") > 0.0008))
        .unionByName(named(missing, "IndexDrift", F.col("value") > 0))
        .unionByName(named(depth, "IngestionBacklog", F.col("value") > 250))
        .unionByName(named(p95, "P95LatencyHigh", F.col("quantile") > 7.5))
    )

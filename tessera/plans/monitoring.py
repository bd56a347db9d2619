"""Operational analytics: histograms, summaries, buckets, profiles, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import conversations, statistics
from tessera.plans.registry import query
from tessera.sources.tables import RUNS_SQL, runs, table

START = "2024-01-01 00:00:00"


@query(f"WITH {RUNS_SQL} SELECT tenant, status, count(*) AS n FROM runs GROUP BY 1, 2")
def status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).groupBy("tenant", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {RUNS_SQL}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, run_id DESC) AS r FROM runs WHERE status = 'SUCCESS') WHERE r <= 1000),
l AS (SELECT tenant, avg(duration_ms) AS avg_ms, list_sort(list(duration_ms)) AS d FROM latest GROUP BY tenant)
SELECT tenant, count(*) AS total, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  CAST(count(*) FILTER (WHERE status = 'SUCCESS') AS DOUBLE) / count(*) AS success_rate, any_value(avg_ms) AS avg_ms,
  any_value(d[CAST(least(len(d) - 1, floor(len(d) * 0.95)) AS BIGINT) + 1]) AS p95_ms
FROM runs JOIN l USING (tenant) GROUP BY tenant""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over all runs; mean and 95th percentile over each tenant's latest 1000 successes."""
    all_runs = runs(spark, sf)
    newest = Window.partitionBy("tenant").orderBy(F.desc("ts"), F.desc("run_id"))
    latest = all_runs.filter("status = 'SUCCESS'").withColumn("_r", F.row_number().over(newest)).filter("_r <= 1000")
    p95 = statistics.percentiles(latest, ["tenant"], "duration_ms", p95_ms=statistics.percentile_floor("duration_ms", 0.95)).drop("n")
    mean = latest.groupBy("tenant").agg((F.sum("duration_ms") / F.count("*")).alias("avg_ms"))
    totals = all_runs.groupBy("tenant").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "FAILED").alias("failed"), (F.count_if(F.col("status") == "SUCCESS").cast("double") / F.count("*")).alias("success_rate")
    )
    return totals.join(mean, "tenant").join(p95, "tenant")


@query(f"""WITH {RUNS_SQL}, b AS (SELECT least(46, (epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) // (CAST(30 AS BIGINT) * 24 * 3600 * 1000000 // 47)) AS bucket, * FROM runs
  WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{START}' + INTERVAL 720 HOUR)
SELECT s.bucket, count(run_id) AS n, count(*) FILTER (WHERE status = 'FAILED') AS failed, coalesce(sum(duration_ms) FILTER (WHERE status = 'SUCCESS'), 0)::BIGINT AS success_ms
FROM (SELECT unnest(generate_series(0, 46)) AS bucket) s LEFT JOIN b USING (bucket) GROUP BY 1""")
def timeseries_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """47 buckets over 720 hours, dense."""
    ok = F.when(F.col("status") == "SUCCESS", F.col("duration_ms"))
    out = statistics.time_buckets(runs(spark, sf), "ts", START, 720, 47, F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.sum(ok).alias("success_ms"))
    return out.select("bucket", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "failed", "success_ms")])


@query(f"""WITH {RUNS_SQL}, d AS (SELECT tenant, list_sort(list(duration_ms)) AS d FROM runs GROUP BY 1)
SELECT tenant, len(d) AS n, d[CAST(least(len(d) - 1, floor(len(d) * 0.5)) AS BIGINT) + 1] AS p50, d[CAST(least(len(d) - 1, floor(len(d) * 0.95)) AS BIGINT) + 1] AS p95 FROM d""")
def percentile_floor(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.percentiles(runs(spark, sf), ["tenant"], "duration_ms", p50=statistics.percentile_floor("duration_ms", 0.5), p95=statistics.percentile_floor("duration_ms", 0.95))


@query(f"""WITH {RUNS_SQL} SELECT tenant, count(*) AS n, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM runs GROUP BY 1""")
def percentile_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.percentiles(runs(spark, sf), ["tenant"], "duration_ms", p50=statistics.percentile_nearest("duration_ms", 0.5), p95=statistics.percentile_nearest("duration_ms", 0.95))


@query(f"""WITH {RUNS_SQL}, s AS (SELECT user_id, CAST(count(*) FILTER (WHERE status = 'SUCCESS') AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM runs GROUP BY 1),
m AS (SELECT *, h / n AS mean, CASE WHEN n > 1 THEN sqrt((n * h - h * h) / (n * (n - 1)) / n) * 1.96 ELSE 0 END AS half FROM s)
SELECT user_id, mean, greatest(0, mean - half) AS low, least(1, mean + half) AS high FROM m""")
def ci95_by_group(spark: SparkSession, sf: str) -> DataFrame:
    counts = runs(spark, sf).groupBy("user_id").agg(F.count_if(F.col("status") == "SUCCESS").alias("h"), F.count("*").alias("n"))
    mean, low, high = statistics.ci95(F.col("h"), F.col("n"))
    return counts.select("user_id", mean.alias("mean"), low.alias("low"), high.alias("high"))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS bases, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations,
(SELECT count(*) FROM conversations WHERE role = 'user') AS questions, (SELECT count(*) FROM labels WHERE quality = 1) AS liked, (SELECT count(*) FROM labels WHERE quality = 0) AS disliked,
(SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed""")
def dashboard_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar counts over five tables, each aggregated to one row before they meet."""
    parts = [
        table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("bases")),
        table(spark, sf, "conversations").agg(F.countDistinct("conv_id").alias("conversations"), F.count_if(F.col("role") == "user").alias("questions")),
        table(spark, sf, "labels").agg(F.count_if(F.col("quality") == 1).alias("liked"), F.count_if(F.col("quality") == 0).alias("disliked")),
        table(spark, sf, "events").agg(F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("failed")),
    ]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


@query("SELECT user_id, event_type, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def intent_distribution(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("user_id")))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang, source, n, CAST(total AS BIGINT) AS total, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank, sum(n) OVER (PARTITION BY lang) AS total FROM c) WHERE rank <= 5""", ints=("rank",))
def top5_with_share(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.top_with_share(table(spark, sf, "documents"), ["lang"], "source", 5).select("lang", "source", "n", "total", "rank")


@query("""SELECT conv_id, count(*) AS questions, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE text LIKE '%?%') AS asks, count(*) FILTER (WHERE contains(text, chr(10))) AS multiline
FROM conversations WHERE role = 'user' GROUP BY 1""")
def query_style(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "conversations").filter("role = 'user'")
    return asked.groupBy("conv_id").agg(
        F.count("*").alias("questions"), F.sum(F.char_length("text")).alias("chars"), F.count_if(F.contains("text", F.lit("?"))).alias("asks"), F.count_if(F.contains("text", F.lit("\n"))).alias("multiline")
    )


@query("""WITH u AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT count(*) AS conversations, count(*) FILTER (WHERE n > 1) AS followed, CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) / count(*) AS rate FROM u""")
def followup_rate_having(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n"))
    more = F.count_if(F.col("n") > 1)
    return per.agg(F.count("*").alias("conversations"), more.alias("followed"), (more.cast("double") / F.count("*")).alias("rate"))


@query("""SELECT q.conv_id, q.turn, coalesce((SELECT min(a.turn) FROM conversations a WHERE a.conv_id = q.conv_id AND a.role = 'assistant' AND a.turn >= q.turn), -1) AS answer_at
FROM conversations q WHERE q.role = 'user'""")
def asof_forward_answer(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.following(table(spark, sf, "conversations"), "conv_id", "turn", "user", "assistant").select("conv_id", "turn", F.coalesce("answer_at", F.lit(-1)).alias("answer_at"))


@query("""SELECT a.conv_id, a.turn, coalesce((SELECT max(q.turn) FROM conversations q WHERE q.conv_id = a.conv_id AND q.role = 'user' AND q.turn <= a.turn), -1) AS question_at
FROM conversations a WHERE a.role = 'assistant'""")
def asof_backward_question(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.preceding(table(spark, sf, "conversations"), "conv_id", "turn", "assistant", "user").select("conv_id", "turn", F.coalesce("question_at", F.lit(-1)).alias("question_at"))


@query("""SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, CAST(sum((length(text) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS spent FROM conversations) WHERE spent <= 200""")
def history_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    priced = table(spark, sf, "conversations").withColumn("cost", F.floor((F.char_length("text") + 3) / 4))
    return conversations.within_budget(priced, "conv_id", "turn", "cost", 200).select("conv_id", "turn", "spent")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def recent_turns(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.recent_turns(table(spark, sf, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, right(string_agg(role || ': ' || left(text, 320), chr(10) ORDER BY turn), 900) AS summary FROM n WHERE total > 4 AND back > 2 GROUP BY 1""")
def conversation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.summaries(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", 4, 2, 320, 900)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, bad, n, CASE WHEN bad * 100 - lag(bad * 100) OVER (ORDER BY day) >= 1000 THEN 'critical' WHEN bad * 100 - lag(bad * 100) OVER (ORDER BY day) >= 500 THEN 'warning' ELSE 'none' END AS alert FROM d""")
def trend_lag_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Failures per day against the day before. One row per day goes through the single window."""
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    change = (F.col("bad") - F.lag("bad").over(Window.orderBy("d"))) * 100
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "bad", "n", F.when(change >= 1000, "critical").when(change >= 500, "warning").otherwise("none").alias("alert"))


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS happened FROM orders UNION ALL SELECT 'event', event_id, ts FROM events ORDER BY happened DESC, kind, id LIMIT 25 OFFSET 50""")
def merged_pagination(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of two sources merged by time; a page is a top-k, so no source is sorted whole."""
    orders = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("happened"))
    events = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("happened"))
    return orders.unionByName(events).orderBy(F.desc("happened"), "kind", "id").offset(50).limit(25)


@query("""SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1""")
def queue_depth(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.filled_counts(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), "status", ["F", "O", "P", "X"])


CANONICAL = {"F": "SUCCESS", "O": "RUNNING", "P": "QUEUED"}


@query("""WITH u AS (SELECT o_orderstatus AS raw FROM orders UNION ALL SELECT event_type FROM events)
SELECT CASE raw WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING' WHEN 'P' THEN 'QUEUED' ELSE coalesce(upper(raw), 'UNKNOWN') END AS status, count(*) AS n FROM u GROUP BY 1""")
def merged_task_status(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs and tasks under common names; unknown statuses in capitals."""
    raw = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("raw")).unionByName(table(spark, sf, "events").select(F.col("event_type").alias("raw")))
    names = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    return raw.groupBy("raw").agg(F.count("*").alias("n")).groupBy(F.coalesce(F.try_element_at(names, F.col("raw")), F.upper("raw"), F.lit("UNKNOWN")).alias("status")).agg(F.sum("n").alias("n"))


@query("""SELECT d.source, count(*) AS voted, count(*) FILTER (WHERE quality = 1) AS up, count(*) FILTER (WHERE quality = 0) AS down, count(*) FILTER (WHERE quality = 0) >= 3 AS alert,
count(*) FILTER (WHERE quality = 1) >= 3 AND count(*) FILTER (WHERE quality = 0) = 0 AS promote FROM labels l JOIN documents d USING (doc_id) GROUP BY 1""")
def feedback_alerts(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    up, down = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return joined.groupBy("source").agg(F.count("*").alias("voted"), up.alias("up"), down.alias("down"), (down >= 3).alias("alert"), ((up >= 3) & (down == 0)).alias("promote"))


@query("""SELECT d.doc_id, CASE WHEN quality = 0 THEN 15 WHEN quality = 1 THEN 95 WHEN length(text) = 0 THEN 20 ELSE least(100, greatest(0, 55 + 15 + CASE WHEN length(text) >= 80 THEN 10 ELSE 0 END - CASE WHEN NOT regexp_matches(text, '[.!?]$') THEN 30 ELSE 0 END)) END AS score,
CASE WHEN quality = 0 THEN 'BAD' WHEN quality = 1 AND toxic = 0 THEN 'GOLDEN' WHEN quality = 1 THEN 'GOOD' ELSE 'UNRATED' END AS label FROM documents d LEFT JOIN labels l USING (doc_id)""")
def answer_quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score from the vote, or from what the answer looks like where there is none; an answer without a final stop counts as interrupted."""
    joined = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id", "left")
    n = F.char_length("text")
    plain = 55 + 15 + F.when(n >= 80, 10).otherwise(0) - F.when(~F.rlike("text", F.lit(r"[.!?]\z")), 30).otherwise(0)
    score = F.when(F.col("quality") == 0, 15).when(F.col("quality") == 1, 95).when(n == 0, 20).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), plain)))
    label = F.when(F.col("quality") == 0, "BAD").when((F.col("quality") == 1) & (F.col("toxic") == 0), "GOLDEN").when(F.col("quality") == 1, "GOOD").otherwise("UNRATED")
    return joined.select("doc_id", score.alias("score"), label.alias("label"))


@query("""SELECT hour(ts) AS hour, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY n DESC, hour LIMIT 5""", ints=("hour",))
def peak_hours(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'view'").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(5)


@query("""SELECT count(*) FILTER (WHERE role = 'user') AS questions, count(DISTINCT conv_id) AS conversations, CAST(count(*) FILTER (WHERE role = 'user') AS DOUBLE) / count(DISTINCT conv_id) AS avg_turns FROM conversations""")
def conversation_totals(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.count_if(F.col("role") == "user")
    return table(spark, sf, "conversations").agg(asked.alias("questions"), F.countDistinct("conv_id").alias("conversations"), (asked.cast("double") / F.countDistinct("conv_id")).alias("avg_turns"))


@query("""SELECT c_mktsegment AS role, n_name AS department, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3 HAVING count(*) > 5""")
def three_way_join_counts(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("role"), F.col("n_name").alias("department"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).filter("n > 5")


@query("""SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 9000""")
def left_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "customer").filter("c_acctbal > 9000")
    return table(spark, sf, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("""SELECT count(*) OVER () AS total, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%high%' ORDER BY o_orderkey LIMIT 20 OFFSET 40""")
def audit_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of filtered rows with the number of all of them; the number is one aggregate, not a window over everything."""
    found = table(spark, sf, "orders").filter((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").ilike("%high%"))
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy("o_orderkey").offset(40).limit(20).select("o_orderkey", "o_orderstatus")
    return page.join(F.broadcast(total), F.lit(True)).select("total", "o_orderkey", "o_orderstatus")
